"""Market-tape analytics on Spark DataFrames."""
