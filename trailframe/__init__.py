"""Road-network analytics on Spark: sources, classification, joins, graphs, routes, streams."""
