"""Docketry: analytics over evidence-backed document collections, on Spark DataFrames."""
