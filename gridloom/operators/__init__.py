"""Delayed operations: each returns a new matrix and runs nothing."""
