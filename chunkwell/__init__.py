"""chunkwell: content-addressed versions, stores and their dedup analytics as Spark DataFrames."""
