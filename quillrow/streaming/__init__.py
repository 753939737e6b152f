"""Incremental parsing: documents that arrive in chunks."""
