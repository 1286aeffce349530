"""loomgraph: code-graph analytics as Spark DataFrames."""
