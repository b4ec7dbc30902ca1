import os
import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("the of and to in is was for on that by this with are from be as at it an".split()) + str(rng.randrange(30)) for _ in range(n))
    passage = say(14)
    docs = [(i, say(120)) for i in range(60)] + [(100 + i, "!! ".join(say(60).upper().split())) for i in range(30)]
    docs += [(200, docs[0][1]), (201, docs[0][1] + " end"), (202, say(50) + " " + passage + " " + say(50)), (203, say(90) + " password=b7db7aa4a5fcc78305 " + say(9)), (204, None)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(out) and not set(range(100, 130)) & set(out)
    assert 200 not in out and 202 in out and 203 in out
    assert passage not in out[202].text and "b7db7aa4a5fcc78305" not in out[203].text
    assert all(r.round_trip and r.n_tokens * 4 == len(r.token_ids) for r in out.values())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_odd_columns_and_empty_tables_pass_every_stage(spark, tmp_path):
    texts = ["the of and to in " * 30 + str(k) for k in range(12)] + [None, "", "X! " * 90]
    rows = [(k if k % 5 else None, t, "en", "s", len(t or ""), k, k, k, k, k, k) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _ int, rest int, row int, found int, `a.b` int, none int"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, int(k != 14), 0) for k in range(15)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some thing")], "item_id long, text string")
    for name, kept in (("some", docs), ("none", docs.limit(0))):
        folder = tmp_path / name
        kept.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        assert all(r["_"] == r["rest"] == r["row"] == r["found"] == r["a.b"] == r["none"] for r in got)
        assert bool(got) == (name == "some")
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(shared) if f.startswith("pipeline-")]
