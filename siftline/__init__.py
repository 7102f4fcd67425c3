"""siftline: incremental text and code retrieval analytics on Spark DataFrames."""
