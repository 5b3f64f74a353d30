"""graphloom: knowledge-graph construction, query and evaluation on Spark."""
