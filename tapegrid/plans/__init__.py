"""Composite plans and the query catalogue."""
