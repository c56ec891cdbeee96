"""Helpers for hot groups: a third of all rows shares one key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scale
from tidemark.functions.scale import collect_in_pages, exact_percentiles, top_per_group, with_dense_rank


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}"
        value = rng.choice([None, 0.0, -5.5, rng.uniform(-1e3, 1e6), float(rng.randint(0, 9))])
        rows.append((i, key, value))
    return rows, spark.createDataFrame(rows, "id long, key string, value double")


def groups(rows):
    out = {}
    for i, k, v in rows:
        out.setdefault(k, []).append((i, v))
    return out


@pytest.mark.parametrize("most", [20_000, 300])
def test_close_values_are_spread(spark, monkeypatch, most):
    """300,000 distinct values of one key between 1000 and 1010: no range holds many, and results are exact."""
    monkeypatch.setattr(scale, "VALUES", most)
    df = spark.range(300_000).select(F.when(F.col("id") % 100 == 0, "few").otherwise("hot").alias("key"),
                                     (1000 + F.col("id") * 7919 % 300_000 / 30_000).alias("value"))
    ranges = scale.in_ranges(df, ["key"], "value").groupBy("key", "_bucket").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("key", "_bucket").collect()
    hot = [r for r in ranges if r["key"] == "hot"]
    assert max(r["n"] for r in ranges) <= (6500 if most == 20_000 else 700) and len(hot) >= 60
    assert all(a["high"] < b["low"] for a, b in zip(hot, hot[1:]))
    values = {"hot": [], "few": []}
    for r in df.collect():
        values[r["key"]].append(r["value"])
    got = {(r["key"], r["prob"]): r["value"] for r in exact_percentiles(df, "key", "value", [0.0, 0.3333, 0.99, 1.0]).collect()}
    assert got == {(k, p): pytest.approx(np.percentile(v, p * 100), rel=1e-12) for k, v in values.items() for p in (0.0, 0.3333, 0.99, 1.0)}
    ranked = with_dense_rank(df, "key", "value", "rank").groupBy("key").agg(F.max("rank").alias("last"), F.countDistinct("rank").alias("n"),
                                                                            F.max_by("value", "rank").alias("least")).collect()
    assert {r["key"]: (r["last"], r["n"], r["least"]) for r in ranked} == {k: (len(v), len(v), min(v)) for k, v in values.items()}


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 0.999, 1.0])
def test_percentiles_equal_numpy(skewed, p):
    rows, df = skewed
    got = {r["key"]: r["value"] for r in exact_percentiles(df, "key", "value", [p]).collect()}
    for key, members in groups(rows).items():
        values = [v for _, v in members if v is not None]
        if values:
            assert got[key] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_percentiles_without_keys(skewed):
    rows, df = skewed
    values = [v for _, _, v in rows if v is not None]
    got = {r["prob"]: r["value"] for r in exact_percentiles(df, None, "value", [0.1, 0.9]).collect()}
    assert got == {p: pytest.approx(np.percentile(values, p * 100)) for p in (0.1, 0.9)}


def test_dense_rank_with_nulls_last(skewed):
    rows, df = skewed
    got = {r["id"]: r["rank"] for r in with_dense_rank(df, "key", "value", "rank").collect()}
    for members in groups(rows).values():
        distinct = sorted({v for _, v in members if v is not None}, reverse=True)
        for i, v in members:
            assert got[i] == (distinct.index(v) + 1 if v is not None else len(distinct) + 1)


def test_top_per_group(skewed):
    rows, df = skewed
    order = [F.desc_nulls_last("value"), F.asc("id")]
    got = {}
    for r in top_per_group(df, "key", order, 7, ["id"], rank="r").collect():
        got.setdefault(r["key"], []).append((r["r"], r["id"]))
    for key, members in groups(rows).items():
        best = sorted(members, key=lambda m: (m[1] is None, -(m[1] or 0.0), m[0]))[:7]
        assert [i for _, i in sorted(got[key])] == [i for i, _ in best]


def test_pages_hold_everything(skewed):
    rows, df = skewed
    paged = collect_in_pages(df, "key", F.col("id"), F.struct("id"), 100)
    assert paged.agg(F.max(F.size("items"))).first()[0] <= 100
    back = sorted(r["id"] for r in paged.select(F.explode("items.id").alias("id")).collect())
    assert back == [i for i, _, _ in rows]
