"""Incremental runs.  There are no stream operators here, only the batch resume of an interrupted output."""
