"""Archive, compressed-data and training-corpus analytics on Spark DataFrames."""
