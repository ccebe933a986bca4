"""Readers, writers, schemas and the table layout."""
