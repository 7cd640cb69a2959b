"""Table, page and file scans, and file sinks."""
