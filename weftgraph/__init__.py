"""Connected sets and the graph dataflow around them, as Spark DataFrames."""
