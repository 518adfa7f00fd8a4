"""gridscribe: grounded table-to-text analytics on Spark DataFrames."""
