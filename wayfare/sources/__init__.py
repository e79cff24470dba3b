"""Readers and parsers of documents and messages."""
