"""Structure repair of conversations by depth-first branch and bound.

A repaired conversation's role initials are `(s?(ua)+)?`. Rows are kept, given
another role, deleted, or preceded by inserted empty ones, at least cost; of
equal costs the least audit (the edits' initials in order) counts. What the
search has to know of a row is one small number, so texts stay where they are
until the edits are known.

Rows are sorted by conversation and turn over ranges, so a conversation may lie
in several partitions. One that lies within a partition is searched as a whole;
others by segments, from each state that the grammar can be in to each other
one, and the segments' results are joined pairwise. That changes no result: equal
states at both ends leave the cost and the order of audits of what lies between
to itself, as an audit tells cost and state and so none of equal cost begins
with another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# What edits cost; to keep a truncated row, in whatever role, costs as much more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar: at the start, after s, after u, after a; the role that may come next, and the state that it leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (("user", AFTER_U), ("user", AFTER_U), ("assistant", AFTER_A), ("user", AFTER_U))
#: A row's code: its initial (s, u, a or another) and four times its fault (none, truncated, to be deleted).
INITIALS = "sua"
OTHER = len(INITIALS)
#: Rows of a segment.
SEGMENT = 256
LEGAL_PAIRS = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"

Found = dict[tuple[int, int], tuple[int, str]]


def _bounds(codes: Sequence[int], ends: Sequence[int]) -> list[tuple[int, int]]:
    """For each suffix, and for either role that may come next (user, assistant), no more than it costs to go on to one of the states `ends`.

    What the bound leaves out of account: that s may stand at the start only.
    """
    user, assistant = (0 if any(e != AFTER_U for e in ends) else INSERT), (0 if AFTER_U in ends else INSERT)
    out = [(user, assistant)]
    for code in reversed(codes):
        initial, fault = code % 4, code // 4
        after = out[-1]
        own = []
        for x in (0, 1):
            least = DELETE + after[x]
            if fault < 2:
                more = TRUNCATED * fault
                least = min(least, more + after[1 - x] + (0 if initial == x + 1 else REROLE))
                if initial == 0:
                    least = min(least, more + after[x])
            own.append(least)
        out.append((min(own[0], INSERT + own[1]), min(own[1], INSERT + own[0])))
    return out[::-1]


def search(codes: Sequence[int], entry: int = START, ends: Sequence[int] = (START, AFTER_A)) -> tuple[int, str, int] | None:
    """(cost, audit, state) of the cheapest edits from the state `entry` to one of `ends`, the ASCII-least audit of these; None if there are none.

    Nodes are (row, state). They are left out where their suffix's lower bound, or with equal cost their audit, cannot beat
    the incumbent, and where the node's table knows a prefix at least as good.
    """
    n, lower = len(codes), _bounds(codes, ends)
    alone = not any(e >= AFTER_U for e in ends)  # then no u or a is ever kept: all rows go, but for one s
    best: tuple[int, str, int] | None = None
    known: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if (last := known.get((i, state))) is not None and last <= (cost, audit):
            continue
        if best is not None:
            low = cost + lower[i][state == AFTER_U]
            if low > best[0] or (low == best[0] and audit > best[1][: len(audit)]):
                continue
        known[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, state)
        _, to = NEXT[state]
        steps = [] if alone else [(i, to, cost + INSERT, audit + "I")]
        if i < n:
            initial, fault = codes[i] % 4, codes[i] // 4
            steps.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault < 2:
                more = cost + TRUNCATED * fault
                if initial == 0 and state == START:
                    steps.append((i + 1, AFTER_S, more, audit + "K"))
                if not alone:
                    if initial == (2 if to == AFTER_A else 1):
                        steps.append((i + 1, to, more, audit + "K"))
                    steps.append((i + 1, to, more + REROLE, audit + "R"))
        steps.sort(key=lambda s: (s[2] + lower[s[0]][s[1] == AFTER_U], s[3]), reverse=True)  # the most promising one is taken first
        stack += steps
    return best


def between(codes: Sequence[int]) -> Found:
    """search() of a segment from each state to each that can be reached from it."""
    out: Found = {}
    for entry in (START, AFTER_S, AFTER_U, AFTER_A):
        for end in (START, AFTER_S, AFTER_U, AFTER_A):
            if end >= AFTER_U or end == entry or (entry, end) == (START, AFTER_S):
                found = search(codes, entry, (end,))
                if found is not None:
                    out[entry, end] = found[:2]
    return out


def joined(left: Found, right: Found) -> Found:
    """What between() finds of two segments, one after the other."""
    out: Found = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c and ((a, d) not in out or (cost + more, audit + rest) < out[a, d]):
                out[a, d] = (cost + more, audit + rest)
    return out


def together(parts: Iterable[Found]) -> Found | None:
    """joined() over many, so that each result is copied as often as the number of parts has binary digits."""
    stack: list[tuple[int, Found]] = []
    for p in parts:
        stack.append((1, p))
        while len(stack) > 1 and stack[-1][0] >= stack[-2][0]:
            (k, b), (j, a) = stack.pop(), stack.pop()
            stack.append((j + k, joined(a, b)))
    while len(stack) > 1:
        (k, b), (j, a) = stack.pop(), stack.pop()
        stack.append((j + k, joined(a, b)))
    return stack[0][1] if stack else None


class Piece:
    """What is known of the rows of a conversation that lie together: results between states, and counts."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.segments: list[Found] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first = self.last = self.least = self.most = None

    def add(self, turn: int | None, initial: str, fault: str, n: int) -> None:
        """n equal rows; all but the first are duplicates unless they are blank."""
        if self.first is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.last + initial not in LEGAL_PAIRS
        self.counts["illegal"] += n - 1
        self.last = initial
        if turn is not None and turn != self.most:
            self.counts["turns"] += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if fault in ("blank", "duplicate"):
            self.counts[fault] += n
        else:
            self.counts["truncated"] += fault == "truncated"
            self.counts["duplicate"] += n - 1
        letter = INITIALS.find(initial) if initial else -1
        code = letter if letter >= 0 else OTHER
        for k in range(n):
            self.codes.append(code + 4 * (2 if k or fault in ("blank", "duplicate") else fault == "truncated"))
            if len(self.codes) > SEGMENT:
                self.segments.append(between(self.codes[:SEGMENT]))
                del self.codes[:SEGMENT]
        if len(self.segments) > 64:
            self.segments = [together(self.segments)]

    def result(self, whole: bool) -> Found:
        if whole and not self.segments:
            cost, audit, state = search(self.codes)
            return {(START, state): (cost, audit)}
        return together([*self.segments, between(self.codes)])


_PIECE = "part int, least long, most long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, entry array<int>, state array<int>, cost array<long>, audit array<string>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a sorted partition; only the first and the last may go on elsewhere."""
    part = TaskContext.get().partitionId()
    now, piece, opened = None, None, 0
    kind = None

    def row(whole: bool) -> pa.RecordBatch:
        found = sorted(piece.result(whole).items())
        c = piece.counts
        values = [part, piece.least, piece.most, c["turns"], piece.first, piece.last, c["blank"], c["duplicate"], c["truncated"], c["illegal"], [k[0] for k, _ in found], [k[1] for k, _ in found], [v[0] for _, v in found], [v[1] for _, v in found]]
        types = [pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([now], kind), *[pa.array([v], t) for v, t in zip(values, types, strict=True)]], ["conv_id", *(c.split()[0] for c in _PIECE.split(", "))])

    waiting: list[pa.RecordBatch] = []
    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, turn, initial, fault, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "n")), strict=True):
            if piece is None or conv != now:
                if piece is not None:
                    waiting.append(row(opened > 1))
                now, piece, opened = conv, Piece(), opened + 1
            piece.add(turn, initial, fault, n)
        if len(waiting) > 500:
            yield _merged(waiting)
            waiting = []
    if piece is not None:
        waiting.append(row(False))
    if waiting:
        yield _merged(waiting)


def _merged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    held: list[dict] = []
    kind = None

    def one() -> list:
        found = together({(a, b): (c, x) for a, b, c, x in zip(p["entry"], p["state"], p["cost"], p["audit"], strict=True)} for p in held)
        cost, audit = min(v for (a, b), v in found.items() if a == START and b in (START, AFTER_A))
        counts = {k: sum(p[k] for p in held) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        least = most = None
        for a, b in zip(held, held[1:], strict=False):
            counts["illegal"] += a["last"] + b["first"] not in LEGAL_PAIRS
        for p in held:
            if p["least"] is not None:
                counts["turns"] -= p["least"] == most
                least, most = (p["least"] if least is None else least), p["most"]
        gaps = 0 if least is None else min(most - least + 1 - counts["turns"], 2**63 - 1)
        return [held[0]["conv_id"], gaps, *[counts[k] for k in names[2:6]], cost, audit]

    def batch(rows: list[list]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    out: list[list] = []
    for b in batches:
        kind = b.schema.field("conv_id").type
        for p in b.to_pylist():
            if held and p["conv_id"] != held[0]["conv_id"]:
                out.append(one())
                held = []
            held.append(p)
        if len(out) > 500:
            yield batch(out)
            out = []
    if held:
        out.append(one())
    if out:
        yield batch(out)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, int | None, str, str, dict | None]]:
    """(conv_id, edit, turn, role, text, judged): every row that the repaired conversations have; before each conversation, its judgement with an empty edit.

    A conversation's first row, which has its audit, is followed by its rows in order.
    """
    now, audit, at, state = None, "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            role, state = NEXT[state]
            at += 1
            yield now, "I", None, role, "", None

    for whole in batches:
        for b in tables.parts(whole):
            for r in b.to_pylist():
                if r["audit"] is not None:
                    yield from inserted()
                    now, audit, at, state = r["conv_id"], r["audit"], 0, START
                    yield now, "", None, "", "", r
                    continue
                for _ in range(r["n"]):
                    yield from inserted()
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        continue
                    role = r["role"]
                    if edit == "R":
                        role, state = NEXT[state]
                    else:
                        state = INITIALS.index(role[0]) + 1
                    yield now, edit, r["turn"], role, r["text"], None
    yield from inserted()


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with faults put in by crc32(`conv_id:turn`) modulo 20: 0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets role user. Nulls of the key, of roles and of texts read as one space."""
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.select("conv_id", "turn", "role", "text", (key % 20).alias("k")).where("k != 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _distinct(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, line, fault): equal rows as one; line tells conversation, role and text. Duplicates are not known yet."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    body = F.rtrim("text", F.lit(BLANKS))
    last = F.substring(body, -1, 1)
    fault = F.when(body == "", F.lit("blank")).when(~last.isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    marked = F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit("\n"), F.length("role").cast("string"), F.lit("\n"), F.col("role"), F.col("text"))
    return rows.select("*", F.unhex(F.sha2(marked.cast("binary"), 256)).alias("line"), fault.alias("fault"))


def _judged(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of _distinct() rows."""
    small = rows.select("conv_id", "turn", "role", "line", "n", "fault")
    seen = F.struct(F.col("turn").isNotNull(), "turn")
    first = small.where("fault != 'blank'").groupBy("line").agg(F.min(seen).alias("earliest"), F.count("*").alias("n"))
    met = tables.attach(small.where("fault != 'blank'").withColumnRenamed("n", "of"), first, "line", rows.count())
    met = met.select("conv_id", "turn", "role", "line", F.col("of").alias("n"), F.when(seen == F.col("earliest"), F.col("fault")).otherwise(F.lit("duplicate")).alias("fault"))
    known = met.unionByName(small.where("fault = 'blank'")).withColumn("initial", F.substring("role", 1, 1))
    order = ["conv_id", "turn", "role", "line"]
    ranged = known.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    conv = rows.schema["conv_id"].dataType.simpleString()
    pieces = ranged.select("conv_id", "turn", "initial", "fault", "n").mapInArrow(_pieces, f"conv_id {conv}, {_PIECE}")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_combine, f"conv_id {conv}, {_JUDGED}")


_JUDGED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _with_audits(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Each conversation's judgement, then its rows in order, in one partition; texts are read one batch after another."""
    none = [F.lit(None).cast(t).alias(c) for c, t in judged.dtypes if c != "conv_id"]
    heads = judged.select("*", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("line"))
    both = heads.unionByName(rows.select("conv_id", *none, F.col("turn").cast("long").alias("turn"), "role", "text", "n", "line"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "line")


def judge(turns: DataFrame) -> DataFrame:
    """One row for each conv_id, null one included: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    `turns` has conv_id, turn, role and text; other columns are not read. Rows of one conversation go by turn (nulls first), then
    role, then a digest of the text. Null roles and texts read as one space; a role that is empty has no initial and cannot be kept. Each row's first fault counts:
    blank, duplicate (its role and text came earlier), truncated. Gaps beyond a long are shown as the greatest long. An empty
    table gives an empty result.

    A conversation may be of any size: its rows are judged over ranges, and its texts, which one hash has to read in
    order, pass one task in batches. Its audit, a letter a row, is one value.
    """
    rows = tables.checkpoint(_distinct(turns))
    judged = _judged(rows)
    names = [*judged.columns, "repaired_sha256"]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind[:] = [b.schema.field("conv_id").type]
                yield b

        out: list[list] = []
        digest, first = None, True
        for _, edit, _, role, text, head in _edited(seen()):
            if head is not None:
                if digest is not None:
                    out[-1].append(digest.hexdigest())
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [*kind, *types], strict=True)], names)
                    out = []
                out.append([head[c] for c in names[:-1]])
                digest, first = hashlib.sha256(), True
            else:
                digest.update((("" if first else "\n") + role + ":").encode())
                digest.update(text.encode())
                first = False
        if digest is not None:
            out[-1].append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [*kind, *types], strict=True)], names)

    conv = rows.schema["conv_id"].dataType.simpleString()
    return _with_audits(rows, judged).mapInArrow(run, f"conv_id {conv}, {_JUDGED}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows of each repaired conversation; place counts from 0, edit is K, R or I, inserted rows have no turn. See judge()."""
    rows = tables.checkpoint(_distinct(turns))
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "edit", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind[:] = [b.schema.field("conv_id").type]
                yield b

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [*kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], names)

        out, place, size = [], 0, 0
        for conv_id, edit, turn, role, text, head in _edited(seen()):
            if head is not None:
                place = 0
                continue
            out.append((conv_id, place, edit, turn, role, text))
            place, size = place + 1, size + len(text)
            if len(out) >= 1000 or size > tables.PART_BYTES:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return _with_audits(rows, _judged(rows)).mapInArrow(run, f"conv_id {conv}, place long, edit string, turn long, role string, text string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conv_id of `conversations`, judged after damaged(); one that loses all rows has zeros, an empty audit and the hash of nothing. See judge() for nulls and repeats."""
    turns = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = turns.select("conv_id").distinct()
    found = judge(damaged(turns)).withColumnRenamed("conv_id", "own")

    def shown(c: str) -> Column:
        if c == "repaired_sha256":
            return F.coalesce(c, F.lit(hashlib.sha256(b"").hexdigest())).alias(c)
        return F.coalesce(c, F.lit("") if c == "audit" else F.lit(0).cast("long")).alias(c)

    return every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *[shown(c) for c in found.columns if c != "own"])
