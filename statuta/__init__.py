"""statuta: legal prose to a provenance-carrying knowledge graph, on Spark DataFrames."""
