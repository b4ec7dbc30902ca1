"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made distinct first, so copies meet once. Blocks of equal bits
bring candidates together (two fingerprints that differ in at most four bits
agree on one of five blocks); a bucket that is too large is cut anew by five
blocks of its other bits, which loses no pair. Within buckets each fingerprint
carries its Hamming distances to fixed reference fingerprints: a pair whose
distances to any reference differ by more than the limit is discarded, survivors
are verified, and only a spanning forest of the links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .components import components
from .tables import SENT_KEYS, attach, checkpoint

SHINGLE, SEED, BITS_APART = 4, 42, 4
#: A bucket with more fingerprints is cut anew.
BUCKET = 4096
#: The reference fingerprints.
PIVOTS = np.random.default_rng(20).integers(0, 2**64, 16, dtype=np.uint64)

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def fingerprint(text: str | None) -> int:
    """64 bits, each set if set in over half the XXH64 values of the word shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    digest, n, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 15)].tolist(), ends[k : k + (1 << 15)].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` with simhash, the fingerprint as a (signed) long; an earlier column of that name is replaced."""
    return tables.append(docs, "simhash long", lambda b: [pa.array(np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64))])


def _parts(mask: int, blocks: int) -> list[int]:
    """The bits that `mask` lacks, cut into blocks of about equal size, each added to `mask`."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [mask | sum(1 << k for k in part.tolist()) for part in np.array_split(np.array(free, int), blocks)]


def _recut(rows: DataFrame, blocks: int) -> DataFrame:
    """A row (fp, mask, key) for each row (fp, mask) and each part of its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "mask"))
            known, which = np.unique(mask, return_inverse=True)
            parts = np.array([_parts(m, blocks) for m in known.view(np.uint64).tolist()], np.uint64).reshape(-1, blocks).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, blocks)), pa.array(parts[which].ravel())], ["fp", "mask"])

    return rows.select("fp", "mask").mapInArrow(run, "fp long, mask long").withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def buckets(prints: DataFrame, apart: int = BITS_APART, most: int = BUCKET) -> DataFrame:
    """(key, fp): any two of the distinct fingerprints `prints` at most `apart` bits apart share a key.

    A bucket of more than `most` is cut anew by `apart` + 1 blocks of the bits that its fingerprints may
    still differ in. Each cut leaves a fifth less of these (for four bits), so buckets that small come
    about at the latest when 2 ** bits is no more than `most`, or only `apart` bits are left.
    """
    rows, done, free = _recut(prints.withColumn("mask", F.lit(0).cast("long")), apart + 1), None, 64
    while True:
        free -= free // (apart + 1)  # bits open in a bucket, at most
        sizes = checkpoint(rows.groupBy("key").count().where(F.col("count") > most)) if free > apart else None
        n = sizes.count() if sizes is not None else 0
        if n == 0:
            break
        hot = F.broadcast(sizes.select("key")) if n <= SENT_KEYS else sizes.select("key")
        cold = rows.join(hot, "key", "left_anti").select("key", "fp")
        done = cold if done is None else done.union(cold)
        rows = _recut(rows.join(hot, "key", "left_semi"), apart + 1)
    rows = rows.select("key", "fp")
    return rows if done is None else done.union(rows)


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def forest(key: np.ndarray, fp: np.ndarray, apart: int = BITS_APART) -> np.ndarray:
    """For rows sorted by key, the number of the first row of each one's component by links within buckets."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], key))
    key, fp, table = key[order], fp[order], table[order]
    label = np.arange(n)
    active, lag = np.arange(n), 0
    while len(active):
        lag += 1
        active = active[active + lag < n]
        other = active + lag
        near = (key[active] == key[other]) & (table[other, 0] - table[active, 0] <= apart)  # sorted: what is too far now stays too far
        active, other = active[near], other[near]
        i, j = active, other
        apart_now = label[i] != label[j]
        i, j = i[apart_now], j[apart_now]
        for k in range(1, len(PIVOTS)):
            if len(i) == 0:
                break
            keep = np.abs(table[i, k] - table[j, k]) <= apart
            i, j = i[keep], j[keep]
        if len(i):
            keep = np.bitwise_count(fp[i] ^ fp[j]) <= apart
            i, j = i[keep], j[keep]
        while len(i):
            a, b = label[i], label[j]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            label = _roots(label)
            still = label[i] != label[j]
            i, j = i[still], j[still]
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def links(rows: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """(a, b): a spanning forest of the links within the buckets of `rows` (key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            root = forest(key, fp.view(np.uint64), apart)
            own = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], ["a", "b"])

        for batch in batches:
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if len(key) == 0:
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield edges(*(np.concatenate([*(h[x] for h in held), part]) for x, part in ((0, key[:cut]), (1, fp[:cut]))))
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield edges(*(np.concatenate([h[x] for h in held]) for x in (0, 1)))

    spread = rows.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """(doc_id, simhash, component_id): each row of `docs` with the least doc_id that links reach.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay.
    A null doc_id is never a component_id unless the whole component has none. Other columns are not read.
    """
    prints = checkpoint(fingerprints(docs.select("doc_id", "text")).select("doc_id", "simhash"))
    roots, total = _roots_of(prints, apart)
    return attach(prints, roots, "simhash", total).select("doc_id", "simhash", "component_id")


def _roots_of(prints: DataFrame, apart: int) -> tuple[DataFrame, int]:
    """(simhash, root, component_id, n) and the sum of n: each distinct fingerprint, the least of its component, the component's least doc_id, its rows."""
    distinct = checkpoint(prints.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(buckets(distinct.select("fp"), apart), apart))
    rooted = checkpoint(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.col("n").alias("of"), F.coalesce("root", "fp").alias("root")))
    size, total = rooted.agg(F.count("*"), F.sum("of")).first()
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return attach(rooted, ids, "root", size).select(F.col("fp").alias("simhash"), "root", "component_id", F.col("of").alias("n")), total or 0


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, fingerprint, component_id (null only if no document of the component has an id)."""
    found = groups(tables.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def _row_key(doc_id: str, text: str) -> Column:
    """Equal for rows of equal id and text only."""
    return F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("none")).cast("binary"), F.lit(b"\x00"), F.coalesce(F.col(text), F.lit("")).cast("binary"), F.col(text).isNull().cast("string").cast("binary")), 256)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row, that with the least id (nulls last), then the least text (null last).

    A group is a component of fingerprints, so unrelated rows stay though their ids are null or equal; null and
    empty texts are one group. Rows of equal id and text are told apart by their other columns, as far as
    these can be ordered. The kept row is unchanged, whatever its columns are called. Ids, keys and
    fingerprints decide which rows may stay; texts are shuffled once for that, and once more only where
    several rows of a group have its least id.
    """
    rows = tables.packed(docs).withColumn("row_key", _row_key("doc_id", "text"))
    prints = checkpoint(fingerprints(rows.select("doc_id", "row_key", "text")).select("doc_id", "row_key", "simhash"))
    roots, total = _roots_of(prints, BITS_APART)
    first = attach(prints, roots, "simhash", total).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = checkpoint(first.groupBy("root", "row_key").agg(F.count("*").alias("n")))
    alone = first.groupBy("root").agg((F.sum("n") == 1).alias("alone"), F.count("*").alias("n"))
    first = checkpoint(attach(first, alone, "root", first.count()))  # of rows with a null id in one group there may be many
    met = attach(rows, first, "row_key", total)
    order = F.struct(F.col("text").isNull(), "text", *[f"rest.`{c}`" for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t and "variant" not in t])
    several = met.where(~F.col("alone")).groupBy("root").agg(F.min_by(F.struct("doc_id", "text", "rest"), order).alias("row")).select("row.*")
    return tables.unpacked(met.where("alone").select("doc_id", "text", "rest").unionByName(several), docs)
