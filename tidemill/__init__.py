"""A Spark-native engine for customs and export document data: scans, resolution, extraction, reports."""
