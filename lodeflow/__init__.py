"""Layered dataset analytics on Spark DataFrames."""
