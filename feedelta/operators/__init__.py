"""Row-level operators: key gates, joins, field scans, row payloads."""
