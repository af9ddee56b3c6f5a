"""Readers and writers for the files and tables at the edges."""
