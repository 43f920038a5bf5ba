"""Spatial-tile analytics on Spark DataFrames."""
