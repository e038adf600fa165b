"""Collaborative analytics over pooled tables, expressed as Spark DataFrames."""
