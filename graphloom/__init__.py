"""graphloom: knowledge-graph, retrieval and event analytics as plain functions from DataFrames to DataFrames."""
