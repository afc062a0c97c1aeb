"""Whole jobs, table views and the query catalogue."""
