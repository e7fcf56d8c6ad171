"""Sequence files, tables as sequences, sketch collections, taxonomies and text forms of results."""
