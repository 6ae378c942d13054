"""Operators: each takes and returns DataFrames and only declares the plan."""
