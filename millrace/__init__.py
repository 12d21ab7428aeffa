"""Batch corpus building, retrieval and evaluation on Spark DataFrames."""
