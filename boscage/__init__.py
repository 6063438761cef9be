"""boscage: file-catalog analytics on Spark DataFrames."""
