"""Queries on the driver's smallest tables against plain versions of their contracts."""

import hashlib
import os
import re

import pytest
import xxhash
from gridloom.llm.license_scan import op11_licenses
from gridloom.llm.secret_scan import op10_secrets
from gridloom.llm.simhash import op9_simhash
from gridloom.llm.url_filter import op4_url_filter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_simhash(spark, docs):
    prints = {}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[i] = sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)) if h else 0
    least = {i: i for i in prints}
    ids = sorted(prints)

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                x, y = sorted((root(i), root(j)))
                least[y] = x
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op9_simhash(spark, SF).collect()} == {(i, f"{prints[i]:016x}", root(i)) for i in ids}


def test_secrets(spark, docs):
    want = {}
    for i, t in docs:
        spans = [("assign", 0, m) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 12]
        spans += [("access", 1, m) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [("hex", 2, m) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        line = ",".join(f"{k}:{m.start()}:{m.end()}" for k, _, m in sorted(spans, key=lambda s: (s[2].start(), s[1])))
        want[i] = (*(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(line.encode()).hexdigest())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in op10_secrets(spark, SF).collect()} == want


def test_licenses(spark, docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = {}
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, x) for p, x in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want[i] = (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    got = op11_licenses(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)
    assert all((r.score > 0) == bool(r.labels) and 0 <= r.score <= 1 and r.labels == ",".join(sorted(r.labels.split(","))) for r in got)


def test_url_filter_on_odd_pages(spark, tmp_path):
    rows = [(1, None), (2, "no url"), (None, "http://a.b.example/x"), (4, "http://a.b.example/y"), (4, "http://a.b.example/y"), (5, "")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op4_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == 6 and not any(r.blocked for r in got if r.page_id in (1, 2, 5, None)) and all(r.host is None for r in got if r.page_id in (1, 2, 5))
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op4_url_filter(spark, f"{tmp_path}/none").count() == 0
