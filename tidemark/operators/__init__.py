"""Selectors, window functions, aggregations and binary operators over DataFrames of samples."""
