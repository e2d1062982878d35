"""Operators on tables of documents: routing, conversion, batches."""
