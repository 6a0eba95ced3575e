"""Helpers that shape how plans run: staging of intermediate tables, bounded broadcasts."""
