"""Roster-scoped, multi-year wide-survey reporting on Spark DataFrames.

Every operator is a function from DataFrame to DataFrame that only builds a
logical plan; nothing here collects data unless its docstring says so.
"""
