"""Code knowledge graphs and text analytics on Spark DataFrames."""
