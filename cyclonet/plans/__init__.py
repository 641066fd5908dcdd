"""Registered queries: library jobs over the given tables, with the same result as SQL."""
