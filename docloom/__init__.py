"""Document retrieval and data preparation on Spark DataFrames."""
