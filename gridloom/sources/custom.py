"""A user's own matrix as a data source that is told which rows and columns are wanted."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..matrix import Matrix
from ..plans.selection import Selection, every

_names = itertools.count()
#: Partitions that one read is planned with at most; larger matrices get larger blocks of rows.
PARTITIONS = 100_000

Range = tuple[int, int]
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _ranges(selection: Selection) -> list[Range]:
    """The runs that are selected, or the range about them where there are many."""
    runs = selection.runs()
    return runs if len(runs) <= 64 else [(runs[0][0], runs[-1][0] + runs[-1][1] - runs[0][0])]


def from_blocks(
    spark: SparkSession, read: Callable[[Range, Range], Entries], nrow: int, ncol: int, *,
    block: int = 1024, dtype: str = "double", full: bool = False, sparse: bool = True, p_rows: float = 1.0,
) -> Matrix:
    """A matrix whose entries `read(rows, columns)` returns, as arrays of rows, columns and values within two ranges (start, length).

    It is called in the workers, once for each `block` rows of what a read selects and for each range of columns; what is not
    selected is never asked for. Ranges of many runs may hold positions that are not selected; their entries are left out.
    """
    name = f"gridloom_blocks_{next(_names)}"

    def planned(options: dict) -> list[tuple[Range, Range]]:
        rows, columns = ([tuple(map(int, x.split(":"))) for x in options[k].split(",") if x] for k in ("askedrows", "askedcolumns"))
        size = max(block, -(-sum(n for _, n in rows) * max(1, len(columns)) // PARTITIONS))
        return [((a + k, min(size, n - k)), c) for a, n in rows for k in range(0, n, size) for c in columns]

    class Part(InputPartition):
        def __init__(self, rows: Range, columns: Range):
            super().__init__((rows, columns))
            self.rows, self.columns = rows, columns

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.parts = planned(options)

        def partitions(self) -> list[InputPartition]:
            return [Part(*p) for p in self.parts] or [Part((0, 0), (0, 0))]

        def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
            if partition.rows[1] and partition.columns[1]:
                r, c, v = read(partition.rows, partition.columns)
                types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(v, types[dtype])], ["r", "c", "v"])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"r bigint, c bigint, v {dtype}"

        def reader(self, schema: object) -> DataSourceReader:
            return Reader({k.lower(): v for k, v in self.options.items()})

    spark.dataSource.register(Source)

    def asked(rows: Selection, columns: Selection) -> DataFrame:
        told = {k: ",".join(f"{a}:{n}" for a, n in _ranges(s)) for k, s in (("askedrows", rows), ("askedcolumns", columns))}
        return columns.keep(rows.keep(spark.read.format(name).options(**told).load(), "r", nrow), "c", ncol)

    return Matrix(asked(every(nrow), every(ncol)), nrow, ncol, sparse=sparse, full=full, p_sparse=float(sparse), p_rows=p_rows, dtype=dtype, reader=asked)
