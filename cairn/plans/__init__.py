"""Composed plans: the cleanup chain, the reconstruction pipeline, and the query catalogue."""
