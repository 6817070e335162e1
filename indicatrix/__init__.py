"""Threat-indicator analytics on Spark DataFrames."""
