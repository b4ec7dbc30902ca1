"""Reading tables and drawing bounded training samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textbuf import flat, mix, slices

_GRAIN = 1 << 30
#: Keys sent to all tasks at most: of a table of classes, and of those that attach() takes for hot.
SENT_KEYS, HEAVY, FEW_CLASSES = 100_000, 4096, 100
#: Bytes of text a class that a model is learned from at most.
TRAIN_BYTES = 48 << 20
#: Bytes of text that a task works on at once.
PART_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bounded(rows: DataFrame, by: str, key: str | list[str], most: int, total: float = math.inf) -> DataFrame:
    """About `most` rows of each value of `by` at most, and about `total` in all, chosen by a hash of the column or columns `key`.

    One count by class gives each class its sampling rate, so no sort and no per-class window is needed. The
    rates of up to FEW_CLASSES classes are part of the condition, of more they are sent to all tasks or, beyond
    SENT_KEYS, meet the rows by class. With more classes than `total`, some classes have no row.
    """
    counts = checkpoint(rows.groupBy(by).agg(F.count("*").alias("_of")))
    classes = counts.count()
    wanted = _GRAIN * min(most, total / max(1, classes))
    draw = F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key), F.lit(7)), F.lit(_GRAIN))
    if classes == 0:
        return rows
    if classes <= FEW_CLASSES:
        rates = F.create_map(*[F.lit(x) for k, n in counts.collect() for x in (k, wanted / n)])
        return rows.where(draw < rates[F.col(by)])
    rates = counts.select(F.col(by).alias("_class"), (F.lit(wanted) / F.col("_of")).alias("_rate"))
    met = rows.join(F.broadcast(rates) if classes <= SENT_KEYS else rates, F.col(by) == F.col("_class"))
    return met.where(draw < F.col("_rate")).select(*rows.columns)


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of at most about `most` documents a class with label 0 or 1, ids in `train` only.

    Several labels of one document: the larger counts. Several documents with one id: one counts, that with
    the least text. Null ids and labels are left out. One partition, ordered by a hash of the id: tasks read
    `docs` in parallel and only what was chosen meets.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train)
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = bounded(y, "y", "doc_id", most)  # its size is bounded, so it may be sent to all
    return together(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "y")


def together(sample: DataFrame, label: str) -> DataFrame:
    """A bounded sample (doc_id, text, `label`) in one partition, one row for each id and label: that with the least text, null as empty."""
    one = sample.groupBy("doc_id", label).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return one.select("doc_id", "text", label).repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id", label)


class Repeats:
    """Numbers the rows of a task that have one key, from 0 on.

    Rows of one key have to be alike, so that it doesn't matter which of them has which number: then rows that are dealt
    by key and number are dealt alike again, should a lost task be repeated with its input in another order.
    """

    def __init__(self) -> None:
        self.met: dict[int, int] = {}

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, int)
        size = np.diff(np.append(heads, len(keys)))
        before = [self.met.get(k, 0) for k in keys[order[heads]].tolist()]
        self.met.update(zip(keys[order[heads]].tolist(), (np.array(before, np.int64) + size).tolist(), strict=True))
        out = np.empty(len(keys), np.int64)
        out[order] = np.arange(len(keys)) - np.repeat(heads - np.array(before, np.int64), size)
        return out


#: Rows of one key that are dealt together at most.
ALIKE = 32


def shares(keys: np.ndarray, repeats: Repeats) -> np.ndarray:
    """A number to deal each row by: rows of one key share it up to ALIKE times, so that no key, however often it comes, is one task's."""
    keys = keys.view(np.uint64)
    return mix(keys + mix((repeats.numbers(keys) // ALIKE).astype(np.uint64)))


class Share:
    """Says which rows of a sample, in their order, still fit into `most` bytes of text a class; a class's first row always does."""

    def __init__(self, most: int):
        self.most, self.used = most, {}

    def fits(self, label: object, text: str | None) -> bool:
        used = self.used.get(label)
        size = (used or 0) + len(text or "")
        if used is not None and size > self.most:
            return False
        self.used[label] = size
        return True


def attach(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of `found`, which has one row a `key` and n, the number of rows that have it; inner, by equal keys.

    A key of more than 1 / HEAVY of the `total` rows is sent to all tasks (there are at most HEAVY such
    keys), so a hot key stays where its rows are; the others meet by key. n is left out.
    """
    limit = total // HEAVY
    heavy = found.where(F.col("n") > limit).drop("n")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(found.where(F.col("n") <= limit).drop("n"), key))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the other columns of `docs` in one struct, so that no name of theirs can clash."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame, n_chars: Column | None = None) -> DataFrame:
    """The columns of `docs` in their order from rows that come from packed(); `n_chars`, if given, replaces a column of that name."""

    def own(c: str) -> Column:
        if c in ("doc_id", "text"):
            return F.col(c)
        if c == "n_chars" and n_chars is not None:
            return n_chars.cast(docs.schema[c].dataType).alias(c)
        return F.col(f"rest.`{c}`").alias(c)

    return rows.select(*map(own, docs.columns))


def append(docs: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """`docs` with the columns of the DDL string `fields`, computed from each Arrow batch; columns of the same name are replaced."""
    more = StructType.fromDDL(fields)
    docs = docs.drop(*more.names)
    schema = StructType([*docs.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for b in parts(whole):
                    yield pa.RecordBatch.from_arrays([*b.columns, *compute(b)], [*b.schema.names, *more.names])
        finally:
            release()

    return docs.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` (else PART_BYTES) bytes of text, so that what is made of them stays small; one long text is a slice of its own."""
    if "text" not in batch.schema.names:
        if batch.num_rows:
            yield batch
        return
    for a, b in slices(flat(batch.column("text"))[1], most or PART_BYTES):
        yield batch.slice(a, b - a)


def release(cycles: bool = True) -> None:
    """Hands freed memory back, as Python workers outlive their tasks."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a session with local tasks gets a new one; others fail."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the session's shared folder.

    Spark removes it with the last reference to it if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
