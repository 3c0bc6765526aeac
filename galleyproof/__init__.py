"""Checks of scientific manuscripts at corpus scale, on Spark DataFrames."""
