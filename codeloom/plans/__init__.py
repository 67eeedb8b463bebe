"""Whole lifecycles: building a graph, building a workspace, and the queries on the driver's tables."""
