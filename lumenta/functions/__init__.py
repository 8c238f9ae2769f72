"""Numeric functions that Spark lacks, on values that are already aggregated."""
