import os
import random

import pytest
from gridloom.llm import language, quality, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 !!! 456"), (None, "some words"), (5, "é" * 30_000), (6, "word " * 40_000), (7, "same"), (7, "same")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' as quality_score", "1 as toxicity", "2 as lang_pred", "3 as y", "4 as model")


def test_fold():
    assert toxicity.fold("Ｓtuріd, LÖSER!") == " stupid loser "
    assert toxicity.fold("1d10t $cum in 1984") == " idiot scum in 1984 "
    assert toxicity.fold("tra​sh  cl0wn") == " trash clown "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_lexicon_finds_terms_stems_and_exceptions():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randrange(2, 6)))
    say = lambda n, *more: toxicity.fold(" ".join([w for _ in range(n) for w in [word()]][: n // 2] + list(more) + [word() for _ in range(n // 2)]))
    toxic = [say(40, rng.choice(["grumble", "blockhead"]), rng.choice(["zorkelt", "zorkish", "zorkem"])) for _ in range(200)]
    clean = [say(40) for _ in range(400)] + [say(40, "oak", "blockhead", "bolt") for _ in range(6)]
    lex = toxicity.fit(toxic, clean)
    assert " grumble " in lex.terms and " blockhead " in lex.terms and any(t.startswith(" zork") for t in lex.terms)
    assert len(lex.terms) <= 6 and {" oak blockhead ", " blockhead bolt "} <= set(lex.exceptions)
    a = lex.automaton()
    assert toxicity.weigh(a, toxicity.fold("an oak blockhead bolt"))[0] == 0.0
    assert toxicity.weigh(a, toxicity.fold("you Bl0ckhead"))[0] > 0
    assert toxicity.fit([], clean).terms == {} and toxicity.weigh(None, "  ")[0] == 0.0


def test_odd_rows(spark):
    df = odd(spark)
    for out, columns in (
        (quality.score(spark, df, quality.fit([])), ["quality_score"]),
        (toxicity.score(spark, df, toxicity.Lexicon({" word ": 3.0})), ["toxicity"]),
    ):
        rows = out.select("doc_id", *columns).collect()
        assert len(rows) == len(ODD) and all(0 <= r[1] <= 1 for r in rows)
        assert len({r[1] for r in rows if r[0] in (1, 2, 3)}) == 1
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(spark, df, language.train(train)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and out[1].lang_score == 0.0 and out[None].lang_pred in ("en", "fr")
    assert language.identify(spark, df.limit(0), None).count() == 0
    assert {r.lang_pred for r in language.identify(spark, df, language.train(train.limit(0))).collect()} == {"und"}
    only = language.train(train.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(spark, train, only).collect()} == {"en"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n and not (abs(code.sum(axis=0)) == n).any()


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not quality.train(docs, labels).any() and toxicity.train(docs, labels).terms == {}


@needs_data
def test_held_out_accuracy(spark):
    labels, docs = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.op3_quality(spark, SF).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert got >= 0.95
    got = language.op8_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert got >= 0.95
    rows = toxicity.op1_toxicity(spark, SF).join(labels, "doc_id").where("held_out")
    assert rows.where("toxic = 0 and predicted = 1").count() == 0
    assert rows.where("toxic = 1").agg(F.avg("predicted")).first()[0] >= 0.7
