"""Operators on whole relations: DataFrames in, a DataFrame out."""
