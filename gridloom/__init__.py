"""Lazy two-dimensional numeric matrices on Spark DataFrames."""

from . import operators, plans, sources
from .matrix import Matrix
from .operators import binary, blocks, reshape, unary
from .plans import extract, sinks

__all__ = ["Matrix", "binary", "blocks", "extract", "operators", "plans", "reshape", "sinks", "sources", "unary"]
