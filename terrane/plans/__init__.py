"""The catalogue of queries, and their SQL."""
