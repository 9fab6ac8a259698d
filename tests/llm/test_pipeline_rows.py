"""The pipeline's stages on rows without an id and on different texts of one id: each row keeps what is its own."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{k}" for k in range(400)]


def prose(seed, lines=4):
    chance = random.Random(seed)
    return "\n".join(" ".join(chance.choice(WORDS) for _ in range(12)) + "." for _ in range(lines))


def rows_of(*texts):
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in texts]


A, B, X, Y = (prose(k) for k in range(4))
ODD = rows_of((None, A, "s1"), (None, B, "s2"), (7, X, "s1"), (7, Y, "s2"), (8, prose(8), "s1"), (None, None, "s2"), (9, None, None))


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("op_row", F.lit("clash"))


def told(frame):
    return collections.Counter((r.doc_id, r.text, r.source) for r in frame.collect())


def test_keys_name_rows_and_rise_with_ids(spark, odd):
    keyed, row, same = corpus_pipeline._keyed(odd)
    found = [(r[row], r.doc_id) for r in keyed.collect()]
    assert not same and len({k for k, _ in found}) == len(ODD)
    ids = [i for _, i in sorted(found)]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    sound = spark.createDataFrame(rows_of((3, A, "s"), (1, B, "s")), DOCS)
    assert corpus_pipeline._keyed(sound)[2] and {(r.doc_id, r.op_row) for r in corpus_pipeline._keyed(sound)[0].collect()} == {(1, 1), (3, 3)}


def test_lines_keep_texts_apart(spark, odd, sf_dir):
    assert told(corpus_pipeline.lines(spark, odd, sf_dir)) == told(odd)
    head = A.split("\n")[0]
    more = odd.unionByName(spark.createDataFrame(rows_of((1, head, "s1"), (None, A + "\nof its own here now.", "s1")), DOCS).withColumn("op_row", F.lit("x")))
    out = told(corpus_pipeline.lines(spark, more, sf_dir))
    texts = sorted(t for i, t, _ in out if i is None and t)
    assert "\n".join(A.split("\n")[1:]) in texts or "of its own here now." in texts
    assert B in texts and sum(out.values()) == len(ODD) + 2 and not any(t == A for t in texts)


def test_near_duplicates_leave_namesakes(spark, odd, sf_dir):
    words = X.split(" ")
    near = " ".join([*words[:-1], "edited"])
    more = odd.unionByName(spark.createDataFrame(rows_of((11, near, "s1"), (11, prose(77), "s1"), (None, A, "s3")), DOCS).withColumn("op_row", F.lit("x")))
    out = told(corpus_pipeline.near_duplicates(spark, more, sf_dir))
    assert (11, near, "s1") not in out and out[11, prose(77), "s1"] == 1 and out[7, X, "s1"] == out[7, Y, "s2"] == 1
    assert sum(n for (_, t, _), n in out.items() if t == A) == 1 and out[None, B, "s2"] == 1 and out[None, None, "s2"] == 1


def test_mix_repeats_rows_by_their_own_source(spark, odd, sf_dir):
    out = told(corpus_pipeline.mix(spark, odd, sf_dir))
    inside = set(told(odd))
    assert set(out) <= inside and all(n <= 3 for n in out.values())
    twice = told(corpus_pipeline.mix(spark, odd, sf_dir))
    assert twice == out


def test_quality_judges_each_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    scores = {r.doc_id: r.score for r in corpus_pipeline.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    best, worst = max(scores, key=scores.get), min(scores, key=scores.get)
    assert best in kept and worst not in kept
    nameless = docs.where(F.col("doc_id").isin(best, worst)).withColumn("doc_id", F.lit(None).cast("long"))
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(best, worst)).collect()}
    out = [r.text for r in corpus_pipeline.quality(spark, docs.unionByName(nameless), sf_dir).where("doc_id is null").collect()]
    assert out == [texts[best]]


def test_rows_go_through_all_stages(spark, odd, sf_dir):
    docs = odd.unionByName(spark.createDataFrame([(k, prose(100 + k), "en", f"s{k % 3}", 1) for k in range(20, 40)], DOCS).withColumn("op_row", F.lit("x")))
    before = {t for _, t, _ in told(docs)}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "best_fit_packing":
            assert {t for _, t, _ in told(docs)} <= before, name
    assert docs.where("length > 2048").isEmpty()
