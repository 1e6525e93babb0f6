"""Sources and sinks: collections, binary documents, spreadsheets, XML and JSON."""
