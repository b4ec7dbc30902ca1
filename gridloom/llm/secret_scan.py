"""Secret scans: three fixed patterns, and character Markov models of random strings and ordinary words.

Only DataFrame functions are used. Positions are code points, ends exclusive:
cutting a text by a pattern gives the gaps between its matches, and the running
sum of gap and match lengths gives each match its place. A text is worked on in
blocks that end where no match can cross, and running sums go by chunks, so the
work grows with the text; only an unbroken run longer than a block is one piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# The kinds in their order, each with its pattern.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",  # AKIA[A-Z0-9]+ of 18 characters or more; what follows in a shorter run is shorter still
    "hex": r"[0-9a-f]{16,}",
}
LEAST_VALUE = 12
#: A block has so many code points, and then as many more as it takes to a character that is in no match, or a blank between letters or digits.
BLOCK = r"""(?s).{2048}.*?(?:[^A-Za-z0-9+/_.=\-"':\x20]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])|\z)|(?s).+"""
#: Array elements that are gone through one by one, each copying those before.
CHUNK = 100
#: Runs that the models judge, and the characters that they know.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A run is random if its log-likelihood ratio reaches LEAST_SUM and, by transition, LEAST_MEAN.
LEAST_SUM, LEAST_MEAN = 12.0, 0.35
#: About so many documents, and as many made-up random strings, are learned from.
TRAIN_ROWS = 3000
#: The weight of single characters against that of transitions.
BACK_OFF = 5.0
MASK = "[SECRET]"

SPANS = "array<struct<start:int,rank:int,end:int,text:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(x: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: F.slice(x, i * size + 1, F.lit(size)))


def _before(lengths: Column, depth: int = 1) -> Column:
    """The sum of the lengths before each place of an array; each further depth cuts longer arrays into chunks of chunks."""

    def plain(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, zero, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)

    def by_chunks(chunks: Column) -> Column:
        heads = _before(F.transform(chunks, total), depth - 1)
        return F.flatten(F.zip_with(chunks, heads, lambda c, head: F.transform(plain(c), lambda v: v + head)))

    if depth == 0:
        return plain(lengths)
    return _let(lengths, lambda x: F.when(F.size(x) <= CHUNK, plain(x)).otherwise(_let(_chunks(x, CHUNK), by_chunks)))


def _cut(text: Column, pattern: str, rank: int) -> Column:
    """The matches of a pattern as an array of (start, rank, end, text)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(both: Column) -> Column:
        at = _before(F.transform(both, lambda x: x["gap"] + F.length(x["text"])))

        def span(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["text"])).alias("end"), x["text"].alias("text"))

        return F.zip_with(both, at, span)

    both = _let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda m, g: F.struct(g.alias("gap"), m.alias("text"))))
    return F.when(text.rlike(pattern), _let(both, placed)).otherwise(F.array().cast(SPANS))


def base(text: Column) -> Column:
    """Spans of the fixed patterns in a block, by start, then kind."""
    kinds = [_cut(text, p, i) for i, p in enumerate(PATTERNS.values())]
    value = PATTERNS["assign"]
    kinds[0] = F.filter(kinds[0], lambda s: F.length(F.regexp_extract(s["text"], value, 1)) >= LEAST_VALUE)
    return F.array_sort(F.concat(*kinds))


def blocks(text: Column) -> Column:
    """A text cut where no match can cross."""
    return F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> list[float]:
    """The log-likelihood ratio of each transition, row by row over the alphabet.

    Labelled samples come from about `rows` documents, chosen by a hash of id and text: values that the
    fixed patterns find, and as many digests, are random; runs of 3 to 15 known characters, and longer
    ones without digits, are ordinary. Each model's transitions back off to its single characters.
    Counts by pair of characters are all that reaches the driver, as many as the alphabet has pairs.
    """
    few = tables.bounded(docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("all", F.lit(1)), "all", ["doc_id", "text"], rows)
    text = F.col("text")
    values = F.transform(F.flatten(F.transform(blocks(text), base)), lambda s: F.regexp_replace(s["text"], r"^.*[:=]\x20*[\"']?", ""))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0)), lambda w: (F.length(w) < 16) | ~w.rlike("[0-9]"))
    real = few.select(F.lit(1).alias("random"), F.explode(values).alias("s")).union(few.select(F.lit(0), F.explode(words)))
    made = docs.sparkSession.range(rows).select(F.lit(1).alias("random"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    made = made.select("random", F.explode(F.array("h", F.base64(F.unhex("h")), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", "")), 1, 20))).alias("s"))
    chars = real.union(made).select("random", F.split("s", "").alias("c")).where(F.size("c") >= 2)
    pairs = chars.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))).alias("pair"))
    known = pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
    n = len(ALPHABET)
    counts = {k: [[0.0] * n for _ in range(n)] for k in (0, 1)}
    place = {c: i for i, c in enumerate(ALPHABET)}
    for r in known.groupBy("random", "pair").count().collect():
        counts[r["random"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["count"]
    p = {}
    for k, rows_of in counts.items():
        ends = [sum(x[b] for x in rows_of) + 0.5 for b in range(n)]
        p[k] = [[(x[b] + BACK_OFF * ends[b] / sum(ends)) / (sum(x) + BACK_OFF) for b in range(n)] for x in rows_of]
    return [round(max(-6.0, min(6.0, math.log(p[1][a][b] / p[0][a][b]))), 4) for a in range(n) for b in range(n)]


def ratio(s: Column, table: Column) -> Column:
    """The summed log-likelihood ratio of a run of known characters."""
    chars = F.transform(F.split(s, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    return F.aggregate(
        F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))),
        F.struct(F.element_at(chars, 1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.element_at(table, (acc["last"] - 1) * len(ALPHABET) + c)).alias("sum")),
    )["sum"]


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """`docs` with base_spans and added_spans (arrays of start, rank, end, text); earlier columns of these names are replaced.

    Null and empty texts have none. An added span overlaps no base span and has the rank after the last kind;
    of a run that base spans cover in part, each part outside them is judged by itself, however short.
    Rows are judged one by one, so ids, repeats and other columns don't matter.
    """
    llr = F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<double>)")

    def random(s: Column) -> Column:
        r = ratio(s["text"], llr)
        return (r >= LEAST_SUM) & (r >= LEAST_MEAN * (F.length(s["text"]) - 1))

    def outside(s: Column, spans: Column) -> Column:
        """The parts of a run outside the base spans of its block."""

        def span(a: Column, b: Column) -> Column:
            return F.struct(a.alias("start"), s["rank"].alias("rank"), b.alias("end"), F.substring(s["text"], a - s["start"] + 1, b - a).alias("text"))

        def step(acc: Column, b: Column) -> Column:
            parts = F.when(b["start"] > acc["at"], F.concat(acc["parts"], F.array(span(acc["at"], b["start"])))).otherwise(acc["parts"])
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), parts.alias("parts"))

        def parts(over: Column) -> Column:
            end = F.array(span(s["end"], s["end"]))
            zero = F.struct(s["start"].alias("at"), F.array().cast(SPANS).alias("parts"))
            return F.when(F.size(over) == 0, F.array(s)).otherwise(F.aggregate(F.concat(over, end), zero, step)["parts"])

        return _let(F.filter(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), parts)

    def moved(spans: Column, at: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["end"] + at).alias("end"), s["text"].alias("text")))

    def judged(text: Column, at: Column) -> Column:
        def both(spans: Column) -> Column:
            added = F.filter(F.flatten(F.transform(_cut(text, CANDIDATE, len(PATTERNS)), lambda s: outside(s, spans))), random)
            return F.struct(moved(spans, at).alias("base"), moved(added, at).alias("added"))

        return _let(base(text), both)

    found = tables.fresh(docs, "found")
    docs = docs.drop("base_spans", "added_spans").withColumn(found, _let(blocks(F.coalesce("text", F.lit(""))), lambda b: F.zip_with(b, _before(F.transform(b, F.length)), judged)))
    return docs.withColumns({f"{k}_spans": F.flatten(F.col(f"`{found}`.{k}")) for k in ("base", "added")}).drop(found)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*PATTERNS, "markov")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, n_assign, n_access, n_hex, base_sha256, spans; a null text reads as empty."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.rank = {i})) as bigint) as n_{k}") for i, k in enumerate(PATTERNS)]
    out = scan(docs, train(docs))
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"))


def masked(text: Column, spans: Column, depth: int = 2) -> Column:
    """The text with a mask in place of each run of overlapping spans; `spans` are sorted by start.

    Many spans are cut into chunks, each with its part of the text, so that no span is looked for from the start of a long text.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        out = F.when(s["start"] >= acc["at"], more).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"), acc["text"].alias("text"))

    def plain(text: Column, spans: Column) -> Column:
        return F.aggregate(spans, F.struct(zero["at"].alias("at"), zero["out"].alias("out"), text.alias("text")), step, lambda acc: F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, F.length(acc["text"]))))

    if depth == 0:
        return plain(text, spans)

    def by_chunks(text: Column, chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        ends = F.aggregate(ends, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))  # how far the chunks so far reach, from none on

        def one(ends: Column) -> Column:
            def part(c: Column, i: Column) -> Column:
                at = F.element_at(ends, i + 1)
                to = F.when(i + 1 == F.size(chunks), F.length(text)).otherwise(F.element_at(ends, i + 2))
                own = F.transform(c, lambda s: F.struct((s["start"] - at).alias("start"), (s["end"] - at).alias("end")))
                return masked(F.substring(text, at + 1, to - at), own, depth - 1)

            return F.array_join(F.transform(chunks, part), "")

        return _let(ends, one)

    def choose(x: Column) -> Column:
        text, spans = x["text"], x["spans"]
        return F.when(F.size(spans) == 0, text).when(F.size(spans) <= CHUNK, plain(text, spans)).otherwise(_let(_chunks(spans, CHUNK**depth), lambda c: by_chunks(text, c)))

    return _let(F.struct(text.alias("text"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")), choose)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays; spans found in its text are masked and n_chars follows, all else is unchanged, whatever it is called.

    Rows are masked one by one, so ids and repeats don't matter; null texts stay null, an empty table stays empty.
    """
    spans = F.array_sort(F.concat("base_spans", "added_spans"))
    out = scan(tables.packed(docs), train(docs)).withColumn("spans", spans)
    out = out.withColumn("found", F.size("spans") > 0).withColumn("text", F.when(F.col("found"), masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return tables.unpacked(out, docs, F.when(F.col("found"), F.length("text")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None)
