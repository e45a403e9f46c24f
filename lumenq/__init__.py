"""A SQL engine over typed collections with vectors, compiled to Spark DataFrames."""
