"""Composed plans: full rebuild, partial rebuild, query registry."""
