"""Fiberloom: structural analytics over DataFrames, planned and executed by Spark."""
