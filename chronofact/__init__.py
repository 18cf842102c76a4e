"""Bitemporal evidence retrieval on PySpark DataFrames."""
