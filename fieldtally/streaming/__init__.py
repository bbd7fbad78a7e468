"""Incremental summaries over arriving log files."""
