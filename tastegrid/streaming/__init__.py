"""Incremental updates from streams."""
