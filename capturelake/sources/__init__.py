"""Readers and writers for capture folders and working tables."""
