"""Chain and news analytics on Spark: operators from DataFrames to DataFrames."""
