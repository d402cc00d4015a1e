"""Operators: functions from DataFrames and thresholds to a DataFrame."""
