"""lodeweave: entity-alignment and retrieval analytics on Spark DataFrames."""
