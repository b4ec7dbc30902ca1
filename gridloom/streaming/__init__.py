"""Delayed operations on unbounded entries.

A matrix over a streaming DataFrame of (r, c, v) is built by sources.from_coo and takes
scalar, vector, transposition, block, cast and bind operations as projections and stream-static
joins; entries() gives the stream of structural entries. Reads that need absent cells or a whole row
belong to bounded entries: run them per micro-batch with for_each_batch().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..matrix import Matrix
from ..sources.leaves import from_coo


def for_each_batch(stream: DataFrame, nrow: int, ncol: int, use: Callable[[Matrix, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch to `use` as a matrix; repeated positions add up."""
    return stream.writeStream.foreachBatch(lambda df, k: use(from_coo(df, nrow, ncol, combine="sum"), k))
