"""Genomic interval and alignment analytics on Spark DataFrames."""
