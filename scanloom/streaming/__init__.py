"""Incremental runs of file jobs."""
