"""Tallyframe: financial event analytics and corpus building on PySpark DataFrames."""
