"""Incremental front end: file-stream micro-batches merged into the catalogue snapshot."""
