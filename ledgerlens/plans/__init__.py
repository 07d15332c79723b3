"""Composed pipelines (the user-visible queries) and the query catalogue."""
