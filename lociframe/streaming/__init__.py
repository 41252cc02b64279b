"""Iteration over results that don't fit the driver at once."""
