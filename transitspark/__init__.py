"""Public-transport network analytics on Spark DataFrames."""
