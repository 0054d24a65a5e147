"""Similarity, ranking and corpus operators on Spark DataFrames."""
