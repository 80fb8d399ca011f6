"""Operators for text corpora: deduplication, packing, tokens, extraction, scoring and search."""
