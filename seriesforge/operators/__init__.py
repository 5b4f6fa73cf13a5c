"""Operators on measured series: DataFrames in, DataFrames out, no actions inside."""
