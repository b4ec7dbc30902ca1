import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from gridloom.llm import conversation_repair as cr
from gridloom.llm.conversation_repair import damaged, judge, op12_conversation_repair, repair, search

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) by least cost first; rows are (role, text, fault)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, lines
        tail = initials[-1:] if initials else "^"
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        for role in ("user", "assistant"):
            if (tail, role[0]) in (("^", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                heapq.heappush(heap, (cost + 3, audit + "I", i, initials + role[0], (*lines, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for edit, to, extra in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if to and (tail, to[0]) in (("^", "s"), ("^", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                        heapq.heappush(heap, (cost + extra + more, audit + edit, i + 1, initials + to[0], (*lines, f"{to}:{text}")))
    raise AssertionError


def faulted(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def digest_of(conv, role, text):
    return hashlib.sha256((("" if conv is None else f"={conv}") + f"\n{len(role)}\n{role}{text}").encode()).digest()


def plain(turns, damage):
    """The whole of it in one process."""
    found = {}
    for conv, turn, role, text in turns:
        own = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, own in found.items():
        if not own and not damage:
            continue
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest_of(conv, r[1], r[2])))
        rows = faulted(own)
        cost, audit, lines = cheapest(rows)
        turns_ = {r[0] for r in own} - {None}
        gaps = min(max(turns_) - min(turns_) + 1 - len(turns_), 2**63 - 1) if turns_ else 0
        count = lambda f: sum(r[2] == f for r in rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs, most):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randrange(most)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), draw.choice(["Yes.", "No", "", " \t", None, "Why?", "Über!", "x\x0b"])))
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def shown(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_search_equals_full_enumeration():
    faults = ["", "truncated", "blank"]
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in faults]
    for rows in product(kinds, repeat=3):
        codes = [cr.INITIALS.find(r[0]) % 4 + 4 * faults.index(f) for r, f in rows]
        assert search(codes)[:2] == cheapest([(r, f"{k}", f) for k, (r, f) in enumerate(rows)])[:2]


def test_segments_equal_the_whole():
    draw = random.Random(5)
    for _ in range(60):
        codes = [draw.choice([0, 1, 1, 2, 2, 3]) + 4 * draw.choice([0, 0, 0, 1, 2]) for _ in range(draw.randrange(40))]
        parts = [cr.between(codes[k : k + 7]) for k in range(0, len(codes), 7)] or [cr.between([])]
        joined = min(v for (a, b), v in cr.together(parts).items() if a == cr.START and b in (cr.START, cr.AFTER_A))
        assert joined == search(codes)[:2]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain(spark, seed):
    rows = [*made(seed, 80, 9), (None, None, None, None), (None, 3, "user", "Hi."), (7, 2**63 - 1, "user", "x."), (7, -(2**63), "assistant", "y."), *[(900, k % 5, "user", "Same.") for k in range(30)]]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert shown(judge(turns)) == plain(rows, False)
    got = shown(judge(damaged(turns)))
    assert got == [r for r in plain(rows, True) if r[0] in {x[0] for x in got}] and len(got) > 60


def test_long_conversations_lie_in_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 16)
    draw = random.Random(3)
    rows = [(1, k, draw.choice(["user", "assistant", "user", "tool", "system"]), f"{k}{draw.choice(['.', '', '!'])}") for k in range(700)] + [(2, 0, "user", "Hi."), (0, 1, "assistant", "Hi.")]
    rows += [(1, 700 + k, "user", "again.") for k in range(40)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert shown(judge(turns)) == plain(rows, False)


def test_hot_rows_and_broadcast_keys(spark, monkeypatch):
    monkeypatch.setattr(cr.tables, "HEAVY", 4)
    rows = [(1, k, "user", "Same.") for k in range(60)] + [(1, 3, "user", "Same.")] * 50 + made(9, 10, 6)
    assert shown(judge(spark.createDataFrame(rows, SCHEMA))) == plain(rows, False)


def test_repair_gives_the_rows(spark):
    rows = made(4, 40, 8)
    turns = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", line string")
    got = {}
    for r in repair(turns).orderBy("conv_id", "place").collect():
        assert r["place"] == len(got.setdefault(r["conv_id"], []))
        got[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {r[0]: r[8] for r in plain(rows, False)}
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in got.items()} == {c: h for c, h in want.items() if h != hashlib.sha256(b"").hexdigest()}
    assert all(LEGAL.fullmatch("".join(x[0] for x in lines)) for lines in got.values())


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_plain_on_a_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(op12_conversation_repair(spark, sf)) == plain(rows, True)
