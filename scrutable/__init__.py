"""Scrutable: roll-call vote analytics on Spark DataFrames."""
