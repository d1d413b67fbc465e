"""Loops over plans, and the query catalogue with its SQL."""
