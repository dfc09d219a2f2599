"""Catalogue reconciliation and data processing on Spark DataFrames."""
