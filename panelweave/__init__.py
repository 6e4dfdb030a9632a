"""Panel analytics on Spark DataFrames: long ``(date, code, value)`` tables in, DataFrames out."""
