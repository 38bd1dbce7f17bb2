"""Coastal-observation analytics on PySpark."""
