"""Stylistic proof-reading of prose at corpus scale, on Spark DataFrames."""
