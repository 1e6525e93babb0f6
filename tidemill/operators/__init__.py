"""DataFrame operators: scans, filters, joins, summaries, keep-first, changes."""
