"""Vector-space analytics on Spark DataFrames."""
