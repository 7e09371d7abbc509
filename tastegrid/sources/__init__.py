"""Readers, writers and model storage."""
