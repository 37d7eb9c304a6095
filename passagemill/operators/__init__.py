"""Table operators: DataFrames in, DataFrames out."""
