"""Incremental variants over streams of edges."""
