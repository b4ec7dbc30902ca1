import random
import re

from gridloom.llm import license_scan as ls
from gridloom.llm.license_scan import PHRASES, normal, rules, scan, whole_words
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, found int, places string, detections string"
LINES = [
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "distributed under the terms of the GNU Lesser General Public License v2.1 or later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "Copyright (c) 2019 Jemand", "released into the public domain", "BSD 3-Clause License", "0BSD",
    "mit dem Auto und der Licence", "the general public license", "general public", "cc by cc by", "CC BY-SA 3.0", "GPLv3", "the unlicense", "Über MIT-Lizenz", "mit license mit license",
]
SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RULES = [(r, re.compile(whole_words(r.pattern))) for r in rules()]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SEPARATORS.split(low) if w]


def plain(text):
    """Each rule over the whole text, without keywords or windows; suppression by comparing all pairs."""
    words = words_of(text)
    line = " " + "".join(w + " " for w in words)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        places += [(k, k + len(own)) for k in at]
        labels |= {label} if at else set()
    found = []
    for rank, (r, compiled) in enumerate(RULES):
        for m in compiled.finditer(line):
            start = line[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, rank, r.tier, r.label))
    better = lambda a, b: a != b and a[3] <= b[3] and a[0] <= b[0] and b[1] <= a[1] and (a[:2] != b[:2] or a[2] < b[2])
    return len(words), sorted(places), sorted(labels), sorted(d for d in found if not any(better(x, d) for x in found))


def shown(df):
    return {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["places"]], sorted(r["phrase_labels"]), sorted(tuple(x) for x in r["detections"])) for r in df.collect()}


def check(spark, texts):
    rows = [(k, t, 1, "x", "y") for k, t in enumerate(texts)]
    df = scan(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["doc_id", "text", "found", "n_words", "places", "phrase_labels", "detections"]
    assert shown(df) == {k: plain(t) for k, t in enumerate(texts)}


def test_hundreds_of_rules_in_order():
    found = rules()
    assert len(found) > 300 and [r.tier for r in found] == sorted(r.tier for r in found)
    assert all(len(r.pattern.split(" ")) < ls.AROUND for r in found)


def test_equals_every_rule_over_whole_texts(spark):
    draw = random.Random(7)
    texts = [None, "", " .,!", *LINES, "a " * 100 + LINES[0], LINES[3] * 3]
    for _ in range(60):
        texts.append(draw.choice([" ", "\n", " the ", ", "]).join(draw.choice([*LINES, "und mit der Zeit", "lorem ipsum", "été", "x" * 40]) for _ in range(draw.randrange(12))))
    check(spark, texts)


def test_every_rule_is_found_through_its_keyword(spark):
    def one_of(p):
        p = p.replace("[cs]", "s").replace("[0-9]{2}", "21")
        for _ in range(9):
            p = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", p)
        return re.sub(r" ?\?", "", p)

    samples = [one_of(r.pattern) for r in rules()]
    assert all(re.fullmatch(r.pattern, s) for r, s in zip(rules(), samples, strict=True))
    check(spark, [f"before {s} after" for s in samples])


def test_long_texts(spark):
    text = ("mit license and the general public license version 2 cc by " + "word " * 40) * 3000
    r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_words"] == len(words_of(text)) and len(r["places"]) == 6000 and r["places"][-1]["start"] == r["n_words"] - 42
    assert len(r["detections"]) == 9000


def test_empty_table_and_scores(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0
    df = scan(spark.createDataFrame([(1, LINES[0]), (2, "no"), (3, "all rights reserved")], "doc_id long, text string")).select("doc_id", ls.score(F.col("phrase_labels"), F.col("detections")).alias("s"))
    assert {r["doc_id"]: r["s"] for r in df.collect()} == {1: 0.99, 2: 0.0, 3: 0.5}


def test_normal(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "A", "  ÄB-c1 ", "x\x00y\x7fz"])], "k int, text string").select("k", normal(F.col("text")).alias("x"))
    assert {r["k"]: r["x"] for r in df.collect()} == {0: " ", 1: " ", 2: " a ", 3: " Äb c1 ", 4: " x y z "}
