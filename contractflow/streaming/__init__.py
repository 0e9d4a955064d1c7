"""Structured Streaming loop over the batch plan."""
