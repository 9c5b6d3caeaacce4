"""Ravelin: review, rating and basket analytics on Spark DataFrames."""
