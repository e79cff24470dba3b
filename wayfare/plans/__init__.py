"""Whole flows: from files to records."""
