"""Disclosure analytics on Spark: operators over DataFrames, lazy and distributed."""
