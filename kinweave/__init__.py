"""Kinship-network analytics over Spark DataFrames."""
