"""Near-duplicate documents, connected components and embedding links against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_duplicates
from tidemark.llm.components import components


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_near(rows, width, percent):
    sets = {}
    for doc, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[doc] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    links = []
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        small, large = sorted((len(x), len(y)))
        if small and 100 * small >= percent * large:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                links.append((a, b))
    return {d: len(s) for d, s in sets.items()}, brute_components(sets, links)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(k, t) for k, t in enumerate(["", None, "  \n ", "One", "one", "one two", "ONE\ttwo", "one two three", "é É", "x " * 3000, "X " * 2999])]
    number = 100
    for _ in range(60):
        base = draw.choices(vocabulary, k=draw.randrange(20, 200))
        for _ in range(draw.choice([1, 1, 2, 3, 30])):
            words = [draw.choice(vocabulary) if draw.random() < draw.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((number, " ".join(words)))
            number += 1
    return rows


@pytest.mark.parametrize("width,percent,node,block", [(3, 85, 1000, 1024), (5, 80, 40, 16), (3, 85, 25, 1024)])
def test_near_duplicates(spark, texts, monkeypatch, width, percent, node, block):
    monkeypatch.setattr(near_duplicates, "NODE", node)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    docs = spark.createDataFrame([(d, t, 1, 2, "z") for d, t in texts] + [(100, texts[11][1], 5, 6, "y"), (None, "one two", 0, 0, "")],
                                 "doc_id long, text string, n_shingles int, cluster int, id string")
    sizes, want = brute_near(texts, width, percent)
    got = near_duplicates.near_duplicates(docs, width, percent).collect()
    assert len(got) == len(texts) + 2
    wrong = 0
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["n_shingles"] == sizes[r["doc_id"]]
        wrong += r["component_id"] != want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert wrong == 0 if node == 1000 else wrong <= 0.02 * len(got)
    assert near_duplicates.near_duplicates(docs.limit(0), width, percent).count() == 0


def test_components(spark):
    draw = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(501, 700)] + [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(150)]
    frame = spark.createDataFrame(links + [(None, 5), (7, None), (9, 9), (500, 501)], "a long, b long").repartition(7)
    want = brute_components({x for p in links for x in p}, links)
    got = {r["vertex"]: r["component_id"] for r in components(frame, "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)
    assert components(frame.limit(0), "a", "b").count() == 0


def test_a_large_group_is_settled_in_two_steps(spark, monkeypatch):
    """Near copies that only chains join, and strangers in the same candidate cluster, over many blocks."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    draw = random.Random(5)
    words = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(300):
        if k % 40 == 39:  # a drift: later copies are far from the first ones
            for _ in range(8):
                words[draw.randrange(90)] = f"x{k}{draw.random()}"
        copy = list(words)
        copy[draw.randrange(90)] = f"y{k}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clusters = spark.createDataFrame([(k, 0) for k, _ in rows], "id long, cluster long")
    links = near_duplicates.confirmed_links(docs, clusters, 3, 85, "text", "doc_id")
    got = brute_components(range(300), [tuple(r) for r in links.collect()])
    assert got == brute_near(rows, 3, 85)[1] and 1 < len(set(got.values())) < 300


def test_levels_find_the_same_links(spark, sf, monkeypatch):
    """The branching tree against exhaustive comparison over a whole table."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    whole = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 3, 85).collect()}
    monkeypatch.setattr(near_duplicates, "NODE", 8)
    tree = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 3, 85).collect()}
    linked = [d for d in whole if whole[d] != d]
    assert len(linked) > 20 and sum(tree[d] == whole[d] for d in linked) >= 0.95 * len(linked)
    assert all(tree[d] == d for d in whole if list(whole.values()).count(whole[d]) == 1)
