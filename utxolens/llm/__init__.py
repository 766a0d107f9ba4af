"""Operators for text corpora: filters, deduplication, packing, tokens, vectors."""
