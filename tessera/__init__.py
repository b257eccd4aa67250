"""Tessera: associative-memory analytics over Spark DataFrames."""
