"""Readers of variant-call files as Spark data sources."""
