"""Ids of any size in SimHash, and samples of labels of exactly the asked size."""

import random

import pytest

from graphloom.llm import simhash, toxicity

SCHEMA = "doc_id long, text string"


def test_ids_beyond_2_to_the_62(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(200))
    far = [2**62, 2**62 + 1, 2**63 - 1, -(2**63), -5]
    rows = [(i, text) for i in far[:3]] + [(i, text + " end") for i in far[3:]] + [(2**62 + 9, "quite another text of its own kind"), (None, "of no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()}
    near = bin((got[2**62][0] ^ got[-5][0]) & (2**64 - 1)).count("1") <= 4
    least = -(2**63) if near else 2**62
    assert [got[i][1] for i in far[:3]] == [least] * 3 and got[-5][1] == -(2**63)
    assert got[2**62 + 9][1] == 2**62 + 9 and got[None][1] is None
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == {-(2**63), 2**62 + 9, None} | (set() if near else {2**62})


@pytest.mark.parametrize("per_class", [1, 2, 77, 10**6])
def test_no_class_is_lost(spark, per_class):
    n = 300_000
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 50 = 0 AS INT) AS toxic")
    chosen, sizes = toxicity.sampled(labels, per_class)
    got = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    assert sizes == {0: n - n // 50, 1: n // 50} and got == {c: min(per_class, k) for c, k in sizes.items()}
    assert chosen.distinct().count() == sum(got.values())


def test_one_class_or_none(spark):
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    chosen, sizes = toxicity.sampled(one, 5)
    assert sizes == {1: 2} and chosen.count() == 2
    assert toxicity.sampled(one.where("false"), 5)[0].count() == 0
