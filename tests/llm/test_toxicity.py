"""The toxicity operator on labelled documents and on odd rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, toxicity


def test_least_draws_hold_the_first(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"), F.xxhash64("id").alias("draw"))
    local = rows.collect()
    for n in (1, 40, 3000, 9000):
        got = common.least_draws(rows, "label", "draw", n).collect()
        for label in (0, 1):
            first = sorted((r["draw"], r["id"]) for r in local if r["label"] == label)[:n]
            found = sorted((r["draw"], r["id"]) for r in got if r["label"] == label)
            assert found[:len(first)] == first and len(found) <= n + 20
    assert common.least_draws(rows.limit(0), "label", "draw", 5).count() == 0


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_labelled_and_odd_rows(spark, tables):
    docs, labels = tables
    network = toxicity.fit(docs, labels.filter(~common.held_out("doc_id")))
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "plain words " * 3000), (10**6 + 3, "plain words " * 3000), (10**6 + 4, " \t ")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = toxicity.score(rows.withColumn("score", F.lit("old")).withColumn("label", F.lit(1)), network)
    assert sorted(got.columns) == ["doc_id", "label", "predicted", "score", "text"]
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert got.count() == rows.count() and all(0 <= s <= 1 for s in scores.values())
    assert got.filter((F.col("score") >= 0.3) != (F.col("predicted") == 1)).count() == 0
    assert scores[10**6] == scores[10**6 + 1] == scores[10**6 + 4] and scores[10**6 + 2] == scores[10**6 + 3]


def test_held_out_rows_are_ranked(spark):
    """Only rows that fit did not learn from: with some 45 toxic documents to learn from, a toxic one scores above another in over 0.8 of the pairs."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    network = toxicity.fit(docs, labels.filter(~common.held_out("doc_id")))
    held = docs.join(labels.filter(common.held_out("doc_id")).select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic")
    marks = [(r["toxic"], r["score"]) for r in toxicity.score(held, network).collect()]
    bad, fine = ([s for t, s in marks if t == k] for k in (1, 0))
    assert len(bad) > 5 and sum(b > f for b in bad for f in fine) > 0.8 * len(bad) * len(fine)


def test_empty_tables(spark, tables):
    docs, labels = tables
    network = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), network).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs.limit(5), network).collect())
