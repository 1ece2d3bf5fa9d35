"""The table of functions and aggregations, and IEEE arithmetic over columns."""
