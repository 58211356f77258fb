"""Table operators: DataFrames and column names in, DataFrame out."""
