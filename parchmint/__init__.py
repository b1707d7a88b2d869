"""Parchmint: document analytics on Spark DataFrames."""
