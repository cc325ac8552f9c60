"""Continuous re-indexing."""
