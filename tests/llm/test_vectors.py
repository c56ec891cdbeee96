"""Vector links and bit-sliced search against brute force."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import bit_sliced_search, vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, score string"


def rows_of(seed):
    draw = np.random.default_rng(seed)
    rows, number = [], 0
    for cluster in range(40):
        centre = draw.standard_normal(16)
        for _ in range(int(draw.choice([1, 3, 12]))):
            rows.append((number, (centre + draw.standard_normal(16) * draw.choice([0.05, 0.2, 0.4])).astype(np.float32).tolist(), cluster % 4))
            number += 1
    rows += [(number + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies
    number += 30
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    rows += [(number + k, v, 1) for k, v in enumerate(odd)] + [(number + 20, rows[5][1], None), (number + 40, rows[5][1], None)]
    return rows


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, threshold):
    good = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and fine(v) and any(v)]
    near = {i: set() for i, _, _ in rows}
    for i, x, g in good:
        for j, y, h in good:
            if i != j and g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                near[i].add(j)
    component = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = start
                todo += near[x]
    return near, component


@pytest.mark.parametrize("block", [1024, 8])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_links, "BLOCK", block)
    rows = rows_of(1)
    frame = spark.createDataFrame([(*r, "s", "x") for r in rows] + [(None, rows[0][1], 0, "", "")], SCHEMA).repartition(5)
    near, component = brute_links(rows, 0.93)
    got = vector_links.vector_links(frame, 0.93).collect()
    assert len(got) == len(rows) + 1
    links = sum(map(len, near.values()))
    found = sum(r["n_links"] for r in got)
    assert links > 500 and 0.97 * links <= found <= links
    wrong = [r for r in got if r["vec_id"] is not None and component[r["vec_id"]] != r["component_id"]]
    assert len(wrong) <= 0.02 * len(rows)
    for r in got:
        if r["vec_id"] is not None:
            assert r["n_links"] <= len(near[r["vec_id"]]) and r["kept"] == (r["vec_id"] == r["component_id"])
    assert vector_links.vector_links(frame.limit(0)).count() == 0


def test_recall_at_threshold():
    draw = np.random.default_rng(9)
    x = draw.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * side
    met = (vector_links.hashes(x) == vector_links.hashes(y)).any(1).mean()
    assert met >= 0.96
    assert (vector_links.hashes(x[:7]) == vector_links.hashes(x)[:7]).all()


@pytest.mark.parametrize("shard,block", [(65536, 512), (40, 3)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(bit_sliced_search, "SHARD", shard)
    monkeypatch.setattr(bit_sliced_search, "QUERIES", block)
    rows = rows_of(2) + [(400, [1.0, -3.0], 0), (1000, [0.0] * 16, 0), (2000, rows_of(2)[5][1], 3), (-20, [-1.0] * 16, 3)]
    frame = spark.createDataFrame([(*r, "s", "x") for r in rows] + [(None, rows[0][1], 0, "", ""), (41, rows[41][1], 0, "", "")], SCHEMA).repartition(5)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows + [(41, rows[41][1], 0)] if fine(v)]
    got = {}
    for r in bit_sliced_search.top_k(frame, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:20]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert len(want) > 8 and bit_sliced_search.top_k(frame.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [65536, 40])
def test_top_k_of_large_components(spark, monkeypatch, shard):
    monkeypatch.setattr(bit_sliced_search, "SHARD", shard)
    large = [(500, [2.0**25] + [0.5] * 15, 0), (501, [-2.0**25] + [1.0] * 15, 0), (502, [0.0, 2.0**40] + [1.0] * 14, 0), (503, [0.0, -2.0**40] + [1.0] * 14, 0),
             (504, [2.0**24] + [-1.0] * 15, 0)]
    rows = rows_of(2) + large
    frame = spark.createDataFrame([(*r, "s", "x") for r in rows], SCHEMA).repartition(3)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if fine(v)]
    got = {}
    for r in bit_sliced_search.top_k(frame, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in good:
        if q % 20 == 0 and len(v) == 16:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:20]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert {r[1] for found in got.values() for r in found} >= {500, 501, 502, 503, 504} and 500 in got
    for vectors, problem in [([(20, [2.0**40]), (21, [2.0**40])], "a score of query 20"), ([(20, [2.0**60]), (21, [1.0])], "a quantised component")]:
        with pytest.raises(Exception, match=problem):
            bit_sliced_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()
