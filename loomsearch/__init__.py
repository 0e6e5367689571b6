"""Hybrid search and retrieval on Spark DataFrames."""
