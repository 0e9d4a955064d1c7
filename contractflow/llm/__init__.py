"""Operators for large text corpora: deduplication, token counts, filters, packing and sharding."""
