"""Catalogue-quality analytics on PySpark: declarative DataFrame operators."""
