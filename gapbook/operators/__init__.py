"""The research operators: DataFrames and frozen settings in, DataFrames out."""
