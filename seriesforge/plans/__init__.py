"""Whole queries: operators put together over the test tables, each with its SQL."""
