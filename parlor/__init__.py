"""Collaboration-data analytics on Spark: DataFrames in, one DataFrame out, all tenants at once."""
