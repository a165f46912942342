"""Renewable-resource geography on PySpark DataFrames."""
