"""Scalar expressions and aggregates as columns."""
