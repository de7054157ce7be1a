"""Quernlight: search, memory and code analytics over DataFrames on Spark."""
