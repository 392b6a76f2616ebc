"""Feature encoding and data processing on Spark DataFrames."""
