"""Incremental runs of batch operators.

The capabilities rebuilt here are batch only; this module is an addition, no counterpart of anything.
"""
