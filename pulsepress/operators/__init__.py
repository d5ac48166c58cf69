"""Operators: functions from DataFrames to a DataFrame, built lazily unless they say otherwise."""
