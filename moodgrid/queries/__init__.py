"""The catalogue of runnable queries over the given tables, with their SQL."""
