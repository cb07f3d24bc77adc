"""Document retrieval, chunking and evaluation over Spark DataFrames."""
