import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


def made(n, rng):
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "oro", "ili", "ubu")]
    rows = []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, len(words), rng.integers(5, 120))]
        bad = rng.random() < 0.15
        if bad:
            text[rng.integers(len(text))] = "grimblot" + "abcdef"[rng.integers(6)]
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_learns_from_positives_and_unlabelled(spark):
    rows = made(1_500, np.random.default_rng(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.detect(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id")
    held = found.where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_held_out_labels_are_not_used(spark):
    rows = made(400, np.random.default_rng(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.detect(docs.select("doc_id", "text"), x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_negative_risk_is_reversed_and_empty_fits_give_the_prior():
    assert toxicity.fit([], [], 0.1).score({"x"}, {}) == pytest.approx(0.1)
    p = [toxicity.text_features("grim word") for _ in range(20)]
    model = toxicity.fit(p, p + [toxicity.text_features(f"w{i} v{i}") for i in range(60)], 0.25)
    assert model.score({"grim", "word"}, {}) > 0.7 > 0.3 > model.score({"w1"}, {})


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (4, "x " * 200_000), (4, "x"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.detect(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.detect(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.detect(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).join(labels, "doc_id")
    held = found.where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.93


@pytest.mark.parametrize("hot", ["same text", "other texts"])
def test_an_id_that_owns_a_third_costs_no_more(spark, monkeypatch, hot):
    """Copies of an id in the sample do not meet copies of it in the table."""
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 60)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 200)
    collected, plain = [], toxicity._features
    monkeypatch.setattr(toxicity, "_features", lambda *a: collected.append(plain(*a)) or collected[-1])
    rows = [(i, f"word{i} other{i % 7}", int(i % 5 == 0)) for i in range(1_200)]
    rows += [(3, "grim text" if hot == "same text" else f"grim text {i}", 1) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.detect(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).count() == 1_900
    assert [len(c) for c in collected] == [60, 200]


def test_a_sample_is_bounded_in_characters(spark):
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(50)] * 3, "_id long, _text string")
    assert toxicity.sampled(rows, "s", 20, 10**6).count() == 20
    assert toxicity.sampled(rows, "s", 20, 1_050).count() == 10
    assert toxicity.sampled(rows, "s", 20, 50).count() == 0
    assert toxicity.sampled(rows, "s", 900, 10**6).count() == 50
