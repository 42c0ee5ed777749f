"""Folioforge: a document-processing engine on PySpark DataFrames."""
