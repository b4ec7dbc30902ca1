import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import language, quality, tables, textbuf, toxicity
from pyspark.sql import functions as F

LEXICON = toxicity.Lexicon({" bolt ": 2.0, " scum ": 3.0, " zork": 1.5, " bolts ": 0.5}, {" oak bolt ", " bolt nut ", " zorkel pie "}, slope=4.0, base=-2.0, power=0.5)


def naive_weight(folded):
    places = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    free = [(i, i + len(p)) for p in LEXICON.exceptions for i in places(p)]
    hits = [(i, i + len(p), w) for p, w in LEXICON.terms.items() for i in places(p)]
    return sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in free))


def test_exceptions_take_back_only_what_they_hold():
    a = LEXICON.automaton()
    rng = random.Random(1)
    texts = ["an oak bolt nut and you scum", "oak bolt nut", "bolt nut bolt", "zorkel pie zorkel", "", "scum scum", "bolts"]
    texts += [" ".join(rng.choice(["oak", "bolt", "nut", "scum", "zorkel", "pie", "zorkish", "bolts", "you"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    for t in texts:
        assert toxicity.weigh(a, toxicity.fold(t))[0] == pytest.approx(naive_weight(toxicity.fold(t))), t
    assert toxicity.weigh(a, toxicity.fold(texts[0]))[0] == 3.0


def test_scores_equal_a_naive_matcher(spark):
    rows = [(1, "You zork, b0lt nut and SCUM"), (2, None), (3, ""), (4, "oak bolt " * 3000), (5, "zorkel pie"), (5, "zorkel pie"), (None, "scum")]
    out = toxicity.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), LEXICON).select("text", "toxicity").collect()
    assert len(out) == len(rows)
    for text, p in out:
        folded = toxicity.fold(text)
        x = math.log1p(naive_weight(folded) / (len(folded.split()) + toxicity.OFFSET) ** 0.5)
        assert p == pytest.approx(1 / (1 + math.exp(-(4.0 * x - 2.0))))


def test_alike_texts_are_grouped_and_none_is_lost():
    words = [f"w{i}" for i in range(200)]
    copies = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in (3, 50, 120)]
    other = " ".join(f"v{i}" for i in range(100))
    groups = toxicity._kin([*copies, other, copies[0]])
    assert sorted(map(len, groups)) == [1, 3] and {t for g in groups for t in g} == {*copies, other}


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        at, x = quality.example(rng.integers(0, 40, rng.integers(1, 30)))
        rows.append((at, x, int(at[0] % 2)))
    got = quality.fit(rows, epochs=2)
    z, n, alpha, beta, l1, l2 = {}, {}, 1.0, 1.0, 0.02, 0.02

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    ones = sum(y for *_, y in rows)
    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = {i: weight(i) for i in at.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x.tolist(), strict=True))))
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (p - y) * v * len(rows) / (2 * (ones if y else len(rows) - ones))
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    for i in z:
        assert got[i] == pytest.approx(weight(i), abs=1e-4)


def test_quality_scores_equal_one_text_at_a_time():
    rng = np.random.default_rng(7)
    w = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = ["One two, two!", None, "", "é ü 12 ... aa", "word " * 500]
    got = quality.probabilities(w, *textbuf.flat(pa.array(texts, pa.string())))
    for t, p in zip(texts, got, strict=True):
        f = quality.ngrams(*textbuf.flat(pa.array([t], pa.string())))[0]
        total = sum(float(w[i]) for i in f.tolist())
        assert p == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, quality.SCALE * total / max(1, len(f)) + float(w[-1]))))), rel=1e-3)


def test_decoding_equals_a_plain_one():
    rng = np.random.default_rng(9)
    model = {"names": list("abcdef"), "code": language.codewords(6), "w": None, "b": None}
    bits = model["code"].shape[1]
    model |= {"w": rng.normal(size=(language.DIM, bits)).astype(np.float32), "b": rng.normal(size=bits), "trust": rng.uniform(0.1, 1, bits)}
    x = language.histograms(*textbuf.flat(pa.array(["Hello there", "ab", "", "Ünter den Linden"] * 3, pa.string())))
    best, p, close = language.decode(model, x)
    for k in range(len(x)):
        margins = [sum(float(a) * float(b) for a, b in zip(x[k], model["w"][:, j], strict=True)) + model["b"][j] for j in range(bits)]
        loss = [sum(model["trust"][j] * math.log1p(math.exp(-margins[j] * c[j])) for j in range(bits)) for c in model["code"]]
        share = sorted((math.exp(-v) / sum(math.exp(-u) for u in loss) for v in loss), reverse=True)
        assert loss[best[k]] == pytest.approx(min(loss), rel=1e-4) and p[k] == pytest.approx(share[0], rel=1e-3)
        assert close[k] == (share[0] - share[1] < language.CLOSE)


def test_more_languages_than_rows_to_learn_from(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_TOTAL", 20)
    rows = [(i, f"text of language number {i % 60} {i}", f"l{i % 60}") for i in range(600)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 5 <= len(model["names"]) <= 45
    began = time.time()
    code = language.codewords(13_000)
    assert code.shape[0] == 13_000 and time.time() - began < 60


def test_samples_are_bounded_by_rows_and_bytes_and_read_in_parallel(spark):
    docs = spark.range(4000).selectExpr("if(id < 3000, 7, id) as doc_id", "repeat(chr(97 + cast(id % 26 as int)), 1 + cast(id % 50 as int)) as text").repartition(6)
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    sample = tables.labelled(docs, labels, "quality", F.lit(True), 100)
    rows = sample.collect()
    assert len({r.doc_id for r in rows}) == len(rows) <= 300
    assert [r.text for r in rows if r.doc_id == 7] in ([], ["a"])
    assert sample.rdd.getNumPartitions() == 1 and "Coalesce 1" not in sample._jdf.queryExecution().toString()
    share = tables.Share(10)
    assert [share.fits(y, "x" * n) for y, n in ((0, 50), (0, 1), (1, 4), (1, 6), (1, 1))] == [True, False, True, True, False]


def test_stage_passes_other_columns_through(spark, tmp_path):
    docs = spark.createDataFrame([(i, "good words and more of them", f"q{i}", i) for i in range(8)] + [(None, None, "n", 99)], "doc_id long, text string, quality_score string, rest int")
    spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(100, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.keep_good(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r.quality_score for r in out.where("doc_id is not null").collect()) == [f"q{i}" for i in range(8)]
    assert quality.keep_good(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_closest_codewords_by_blocks():
    import numpy as np
    from gridloom.llm import language

    m = np.random.default_rng(2).choice([-1.0, 1.0], size=(1300, 40))
    products = m @ m.T
    np.fill_diagonal(products, -np.inf)
    assert language._closest(m) == products.max() and language.codewords(9).shape[0] == 9
