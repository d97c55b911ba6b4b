"""Readers, writers and the table layout of a corpus."""
