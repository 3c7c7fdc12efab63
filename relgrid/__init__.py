"""Set-at-a-time relationship analytics on Spark DataFrames."""
