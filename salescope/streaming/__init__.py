"""Incremental imports with Structured Streaming: files dropped into a folder
go through the same import rules as the batch importer."""
