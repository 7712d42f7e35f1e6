"""Procurement-integrity analytics on Spark DataFrames."""
