"""Composed plans: the batch heal plan and the query catalogue."""
