"""File-metadata search and analytics on Spark DataFrames."""
