"""Preparation of records and texts for language-model training.  Nothing else in the library imports this."""
