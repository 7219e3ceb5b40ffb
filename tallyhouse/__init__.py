"""Multi-channel retail sales analytics on Spark DataFrames."""
