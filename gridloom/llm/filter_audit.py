"""How filters of a corpus interact, whatever their order.

Documents are counted by the set of filters that they fail. The subsets of
filters applied so far form a lattice; an edge applies one more filter and
removes what fails it and nothing before. Path counts forward (orders that
reach a subset) and backward (orders that go on from one) weight each edge's
removals, which gives every filter's sum over all orders; the steps of one order
are read from the edges along its path.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

FILTERS = "ABCDE"
#: The filter that takes the whole table to decide: a copy of the text has a smaller id.
COPY = FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def paths(filters: int) -> tuple[list[int], list[int]]:
    """For each subset of the filters, as bits: the orders of its members that lead to it, and the orders of the others that go on from it."""
    full = (1 << filters) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for s in range(full + 1):
        for f in range(filters):
            if s >> f & 1:
                reach[s] += reach[s ^ 1 << f]
    for s in range(full, -1, -1):
        for f in range(filters):
            if not s >> f & 1:
                leave[s] += leave[s | 1 << f]
    return reach, leave


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself; null reads as empty."""

    def judge(x: Column) -> Column:
        def by_words(words: Column) -> Column:
            n = F.size(words).cast("long")
            few, dull = n < LEAST_WORDS, F.size(F.array_distinct(words)).cast("long") * 100 < n * LEAST_DISTINCT
            return few.cast("int") + dull.cast("int") * 2

        capitals = F.length(F.regexp_replace(x, "[^A-Z]+", "")).cast("long")
        loud = capitals * 100 > F.length(x).cast("long") * MOST_CAPITALS
        odd = x.rlike(r"[#$%&*|]")
        return tables.let(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != ""), by_words) + loud.cast("int") * 4 + odd.cast("int") * 8

    return tables.let(F.coalesce(text, F.lit("")), judge)


def states(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents of each lang (null: empty string) by the filters that they fail, as bits, and their labels.

    A document fails the last filter if its text (null: empty) is that of a document with a smaller id; one without
    an id is no smaller than any other and has no smaller one. Repeated rows count repeatedly, those of one id are
    no copies of one another. Of several labels of one id the larger counts; unlabelled documents have neither.
    Other columns are not read. Rows of one text and id meet in an aggregation, so copies of one text are few rows
    where the smallest id is found; labels come to hot ids by broadcast.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), digest.alias("digest"), own_failures(F.col("text")).alias("own"))
    rows = tables.checkpoint(rows.groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n")))
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    by_id = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    found = by_id.join(flags, "doc_id", "left").select("doc_id", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    none = rows.where(F.col("doc_id").isNull()).withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    known = tables.attach(rows.withColumnRenamed("n", "of"), found, "doc_id", rows.count()).withColumnRenamed("of", "n").unionByName(none)
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = known.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("nameless"))
    first = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    met = texts.join(first, "digest")  # a text has as many rows as langs and labels
    stay = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("own").alias("failed"), stay.alias("n")), F.struct((F.col("own") + (1 << COPY)).alias("failed"), (F.col("n") - stay).alias("n")))
    split = met.select("part", "good", "toxic", F.explode(both).alias("s"))
    return split.groupBy("part", F.col("s.failed").alias("failed"), "good", "toxic").agg(F.sum("s.n").alias("n"))


def edges(found: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, before, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): each edge of the lattice, with zeros where nothing is removed.

    `before` has the filters applied so far as bits; shapley is the filter's removals summed over all orders.
    """
    reach, leave = paths(filters)
    full = 1 << filters
    every = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(full - 1))).alias("before")).select("*", F.explode(F.sequence(F.lit(0), F.lit(filters - 1))).alias("filter"))
    bit = F.element_at(F.array(*[F.lit(1 << f) for f in range(filters)]), F.col("filter") + 1)
    every = every.withColumn("bit", bit).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    fails, early = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0

    def counted(of: Column, name: str) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(name)

    sums = every.groupBy("part", "before", "filter", "bit").agg(
        counted(~fails & ~early, "kept"), counted(fails & ~early, "removed"), counted(fails & early, "redundant"), counted(F.col("failed") == F.col("bit"), "unique_fails"),
        counted(fails & ~early & (F.col("good") == 1), "good_lost"), counted(fails & ~early & (F.col("toxic") == 1), "toxic_lost"),
    )

    def at(counts: list[int], place: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast("long") for x in counts]), place + 1)

    weight = at(reach, F.col("before")) * at(leave, F.col("before").bitwiseOR(F.col("bit")))
    whole = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    return sums.join(whole, ["part", "filter"]).drop("bit")


def orders(found: DataFrame, names: str = FILTERS) -> DataFrame:
    """edges() read along every order of the filters: part, filter_order, step and the counts."""
    steps = [("".join(o), k + 1, sum(1 << names.index(x) for x in o[:k]), names.index(f)) for o in permutations(names) for k, f in enumerate(o)]
    along = found.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")  # as many as the filters have orders
    return edges(found, len(names)).join(F.broadcast(along), ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each lang (null: empty string), order of the five filters and step, zeros included; an empty table has no part. See states() for nulls and repeats."""
    return orders(states(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
y AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS failed FROM t),
s AS (SELECT part, failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN y ON f.doc_id = y.doc_id GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, filter, good, toxic, n, failed = filter AS alone, contains(failed, filter) AS fails, translate(earlier, failed, '') <> earlier AS early FROM s CROSS JOIN k),
g AS (SELECT part, filter_order, step, filter,
    CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT early), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT early), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE fails AND early), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT early AND good = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT early AND toxic = 1), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g
"""
