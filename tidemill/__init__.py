"""Analytics and data-processing jobs written for Spark: DataFrames in, DataFrames out."""
