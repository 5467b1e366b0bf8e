"""Operators over DataFrames, grouped by the question they answer."""
