"""Property-graph analytics expressed as Spark DataFrames."""
