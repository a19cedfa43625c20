"""Spark jobs that gate tabular and extracted data before it is loaded."""
