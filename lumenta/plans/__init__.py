"""Metric definitions, statement admission and the investigation that puts the operators together."""
