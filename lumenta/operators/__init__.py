"""Analytical operators. Each takes DataFrames and gives a lazy DataFrame; only result-sized rows reach the driver."""
