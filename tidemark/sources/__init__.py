"""Table scans, the mapped retail schema, and written tables."""
