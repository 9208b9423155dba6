"""Burst detection and accounting over sampled signals, as Spark DataFrames."""
