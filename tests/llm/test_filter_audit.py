import math
from itertools import permutations

from gridloom.llm import filter_audit
from gridloom.llm.filter_audit import edges, orders, own_failures, paths, states
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, n long, part string, failed int"
WORDS = " ".join(f"word{i}" for i in range(120))


def rows_of():
    texts = [None, "", "a b c", WORDS, WORDS, WORDS + " #", "A" * 300, " ".join(["same"] * 200), WORDS.upper(), "  x y " * 60, WORDS, "", "|", WORDS]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 9, 10, 4, None, 12, None]
    langs = ["en", None, "", "en", "de", "en", "fr", "en", None, "en", "en", "de", "fr", "de"]
    return [(i, t, g, 0, "x", 5) for i, t, g in zip(ids, texts, langs, strict=True)]


def by_itself(text):
    x = text or ""
    for c in "\t\n\x0b\x0c\r":
        x = x.replace(c, " ")
    words = [w for w in x.split(" ") if w]
    x = text or ""
    found = "A" if len(words) < 100 else ""
    found += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    found += "C" if 100 * sum("A" <= c <= "Z" for c in x) > 10 * len(x) else ""
    return found + ("D" if any(c in "#$%&*|" for c in x) else "")


def plain(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = [(g or "", by_itself(t) + ("E" if i is not None and i > least[t or ""] else ""), *[any(x[0] == i and i is not None and x[k] == 1 for x in labels) for k in (1, 2)]) for i, t, g, *_ in rows]
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        lines = []
        for o in permutations("ABCDE"):
            for k, f in enumerate(o):
                before = set(o[:k])
                gone = [d for d in own if f in d[1] and not before & set(d[1])]
                removed[f] += len(gone)
                kept = sum(not (before | {f}) & set(d[1]) for d in own)
                lines.append((f, (part, "".join(o), k + 1, kept, len(gone), sum(f in d[1] and bool(before & set(d[1])) for d in own), sum(d[1] == f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))))
        out += [(*x, removed[f]) for f, x in lines]
    return sorted(out)


def test_equals_a_plain_replay_of_every_order(spark):
    rows = rows_of()
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (7, None, 1), (99, 1, 1), (None, 1, 1), (5, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = orders(states(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert sorted(map(tuple, found.collect())) == plain(rows, labels)


def test_empty_tables_have_no_part_and_labels_may_be_missing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert orders(states(spark.createDataFrame([], SCHEMA), labels)).count() == 0
    rows = rows_of()
    assert sorted(map(tuple, orders(states(spark.createDataFrame(rows, SCHEMA), labels)).collect())) == plain(rows, [])


def test_paths_are_factorials_and_all_meet_in_the_ends():
    reach, leave = paths(5)
    assert reach[31] == leave[0] == math.factorial(5)
    assert all(reach[s] == math.factorial(s.bit_count()) and leave[s] == math.factorial(5 - s.bit_count()) for s in range(32))


def test_removals_sum_up_over_any_order(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    found = states(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert edges(found).groupBy("part").count().where("count != 80").count() == 0
    total = found.groupBy("part").sum("n").collect()
    lost = {(r["part"], r["filter_order"]): r["x"] for r in orders(found).groupBy("part", "filter_order").agg({"removed": "sum"}).withColumnRenamed("sum(removed)", "x").collect()}
    kept = {r["part"]: r["kept"] for r in orders(found).where("step = 5").select("part", "kept").distinct().collect()}
    assert len(lost) == 120 * len(total) and all(lost[p, o] + kept[p] == n for p, n in total for q, o in lost if q == p)


def test_long_texts_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.tables, "HEAVY", 4)
    rows = [(1, f"{k} {WORDS}", "en", 0, "", 0) for k in range(40)] + [(k, "w " * 400_000, "en", 0, "", 0) for k in range(2, 5)]
    labels = [(1, 1, 0), (3, 0, 1)]
    found = orders(states(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert sorted(map(tuple, found.collect())) == plain(rows, labels)
    assert spark.createDataFrame([("w " * 400_000,)], "text string").select(own_failures(F.col("text"))).first()[0] == 2
