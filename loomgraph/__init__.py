"""loomgraph: community structure in graphs, computed with Spark DataFrames."""
