"""Operators: functions from DataFrames to lazy DataFrames. None collects unless its docstring says so."""
