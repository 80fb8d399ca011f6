"""Structured Streaming versions of selection, alignment and state tracking."""
