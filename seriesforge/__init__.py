"""Measured series on Spark: calibrate, clean, compare and summarise (time, value) curves."""
