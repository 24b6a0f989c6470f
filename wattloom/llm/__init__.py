"""Operators for text corpora, matching and deduplication; nothing else in the library imports them."""
