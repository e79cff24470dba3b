"""Relational and per-document operators."""
