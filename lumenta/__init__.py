"""Governed business analytics on PySpark: metrics, period comparison, series, panels, retrieval and models as lazy DataFrame plans."""
