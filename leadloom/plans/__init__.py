"""Stage plans, and the catalogue of queries with their SQL."""
