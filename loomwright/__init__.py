"""Retrieval, indexing and evaluation dataflows on Spark DataFrames."""
