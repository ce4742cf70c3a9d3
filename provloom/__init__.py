"""Provenance-graph analytics on Spark DataFrames."""
