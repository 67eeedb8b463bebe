"""Operators over node, edge and fact DataFrames."""
