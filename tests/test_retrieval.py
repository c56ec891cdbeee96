"""Retrieval against brute force on a small corpus with many ties and copies."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import corpus, graph, retrieval
from tidemark.functions import vectors
from tidemark.session import work_path


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = []
    for i in range(400):
        # A third of the rows are copies of one text and one vector.
        body = "alpha beta" if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 12)))
        vec = [1.0, 0.0, 0.5] if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(3)]
        rows.append((f"r{i:03d}", body, [float(np.float32(x)) for x in vec]))
    return rows, spark.createDataFrame(rows, "row_id string, content string, content_embedding array<float>").repartition(4)


def py_bm25(rows, query, k1=1.2, b=0.75):
    toks = {r: t.split() for r, t, _ in rows}
    n, mean = len(rows), sum(map(len, toks.values())) / len(rows)
    scores = {}
    for w in dict.fromkeys(query.split()):
        df = sum(w in t for t in toks.values())
        for r, t in toks.items():
            tf = t.count(w)
            if tf:
                idf = math.log(1 + (n - df + .5) / (df + .5))
                scores[r] = scores.get(r, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
    return {r: round(s, 6) for r, s in scores.items()}


def test_bm25_and_batch_equal_brute_force(spark, docs):
    rows, df = docs
    queries = [("a", "alpha gamma"), ("b", "eps"), ("c", "delta beta eps")]
    table = spark.createDataFrame(queries, "query_id string, query string")
    for result in (retrieval.bm25(df, queries, 9), retrieval.bm25_batch(df, table, 9)):
        for qid, q in queries:
            scores = py_bm25(rows, q)
            best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:9]
            got = sorted((r["rank"], r["row_id"], r["score"]) for r in result.collect() if r["query_id"] == qid)
            assert [(r, pytest.approx(s, abs=2e-6)) for r, s in best] == [(r, s) for _, r, s in got]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_equals_brute_force(docs, metric):
    rows, df = docs
    queries = [("x", [1.0, 0.0, 0.5]), ("y", [0.2, -0.7, 0.1])]
    got = {(r["query_id"], r["rank"]): r["row_id"] for r in retrieval.knn(df, queries, 11, metric=metric).collect()}
    for qid, q in queries:
        x = np.array([v for _, _, v in rows])
        d = np.round(vectors.METRICS[metric](x, np.array(q)), 6)
        best = sorted(zip(d, [r for r, _, _ in rows]))[:11]
        assert [got[qid, i + 1] for i in range(11)] == [r for _, r in best]


def test_rrf_inner_equals_full_ranking(docs):
    rows, df = docs
    q, query = [0.9, 0.1, 0.4], "alpha delta"
    scores = py_bm25(rows, query)
    matched = [(r, v) for r, _, v in rows if r in scores]
    d = dict(zip([r for r, _ in matched], np.round(vectors.l2_rows(np.array([v for _, v in matched]), np.array(q)), 6)))
    by_vec = {r: i + 1 for i, r in enumerate(sorted(d, key=lambda r: (d[r], r)))}
    by_text = {r: i + 1 for i, r in enumerate(sorted(d, key=lambda r: (-scores[r], r)))}
    best = sorted(d, key=lambda r: (-(1 / (60 + by_vec[r]) + 1 / (60 + by_text[r])), r))[:10]
    got = retrieval.rrf_inner(df, query, q).collect()
    assert [(r["row_id"], r["vec_rank"], r["bm25_rank"]) for r in got] == [(r, by_vec[r], by_text[r]) for r in best]


def test_any_number_of_queries(spark, monkeypatch):
    """Several blocks, the last one partial: every query gets its rows."""
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    points = spark.range(30).selectExpr("id row_id", "array(double(id), 0D) v")
    asked = spark.range(24).selectExpr("string(id) query_id", "array(double(id), 0D) vector")
    got = retrieval.knn(points, asked, 1, "row_id", "v").collect()
    assert {r["query_id"]: r["row_id"] for r in got} == {str(i): i for i in range(24)}
    assert retrieval.knn(points, asked.limit(0), 1, "row_id", "v").count() == 0
    texts = spark.range(30).selectExpr("string(id) row_id", "concat('word', id, ' common') content")
    words = spark.range(24).selectExpr("string(id) query_id", "concat('word', id) query")
    expected = {str(i): str(i) for i in range(24)}
    assert {r["query_id"]: r["row_id"] for r in retrieval.bm25_batch(texts, words, 1).collect()} == expected
    monkeypatch.setattr(retrieval, "MATRIX_CELLS", 9)
    assert {r["query_id"]: r["row_id"] for r in retrieval.bm25_batch(texts, words, 1).collect()} == expected


def test_absent_and_ragged_vectors(spark):
    rows = [("a", [3.0, 4.0, 0.0, 0.0]), ("b", []), ("c", None), ("d", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id string, content_embedding array<double>").coalesce(1)
    assert [(r["row_id"], r["distance"]) for r in retrieval.knn(df, [("q", [0.0] * 4)]).collect()] == [("a", 5.0)]
    stats = {r["row_id"]: r["s"] for r in df.select("row_id", vectors.vector_stats("content_embedding").alias("s")).collect()}
    assert stats["b"] is None and stats["c"] is None and stats["a"]["mean"] == 1.75 and stats["d"]["total"] == 2.0
    far = {r["row_id"]: r["d"] for r in df.select("row_id", vectors.distance_to("content_embedding", [0.0, 0.0]).alias("d")).collect()}
    assert far == {"a": None, "b": None, "c": None, "d": round(2 ** 0.5, 6)}
    sample = {r["row_id"]: r["x"] for r in df.select("row_id", vectors.vector_sample("content_embedding").alias("x")).collect()}
    assert sample["b"] is None and sample["c"] is None and sample["d"] == [0.0, 0.0] and len(sample["a"]) == 4


def test_neighbours_and_context_of_a_long_document(spark):
    rows = [("t", "c", f"d-{i}", "d", i, f"text {i}", ["E"]) for i in range(300) if i != 150]
    df = spark.createDataFrame(rows, "tenant_id string, corpus_id string, row_id string, doc_id string, chunk_index int, content string, entity_names array<string>")
    near = {r["src_chunk"]: r["neighbor_chunks"] for r in graph.structural_neighbors(df).collect()}
    assert near["d-149"] == ["d-147", "d-148", "d-151"]
    around = {r["row_id"]: (r["before"], r["after"]) for r in corpus.context_window(df, 2).collect()}
    assert around["d-0"] == ([], ["text 1", "text 2"])
    assert around["d-151"] == (["text 149"], ["text 152", "text 153"])


def test_entity_index_drops_hot_entities(spark):
    rows = [("t", "c", f"r{i}", ["Hot"] + (["Cold"] if i < 5 else [])) for i in range(60)]
    df = spark.createDataFrame(rows, "tenant_id string, corpus_id string, row_id string, entity_names array<string>")
    got = graph.entity_index(df, max_freq=50).collect()
    assert [(r["entity_name"], r["freq"], r["chunk_ids"]) for r in got] == [("Cold", 5, [f"r{i}" for i in range(5)])]


def test_three_hops(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "a"), ("x", "y")]
    triples = spark.createDataFrame([(s, "to", t, f"c{i}") for i, (s, t) in enumerate(edges)],
                                    "source_entity string, relation_type string, target_entity string, chunk_id string")
    got = {(r["source_entity"], r["target_entity"], r["hop"]) for r in graph.hop_edges(triples, ["a"], 3).collect()}
    assert got == {("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("c", "a", 3)}


def test_vector_stats_and_sample(spark):
    vec = [0.0, 1.0, -1.0, 0.005]
    df = spark.createDataFrame([(1, vec)], "id int, v array<float>")
    s = df.select(vectors.vector_stats("v").alias("s")).first()["s"]
    assert (s["min"], s["max"], round(s["sparsity_pct"], 3)) == (-1.0, 1.0, 50.0)
    assert s["l2_norm"] == pytest.approx(np.linalg.norm(np.float32(vec).astype(float)))
    assert df.select(vectors.vector_sample("v", 2).alias("x")).first()["x"] == [1.0, 0.0]


def test_a_step_along_a_stored_graph_does_not_shuffle_triples(spark):
    """Bucketed triples: only the frontier moves, also when it is too large to be broadcast; later loads are found."""
    schema = "tenant_id string, corpus_id string, row_id string, relationships string"
    def chunk(k):
        return ("t", "c", f"r{k}", '[{"source":"e%d","relation":"NEXT","target":"e%d"}]' % (k, (k * 7 + 1) % 500))
    table, path = "test_triples", work_path(spark, "triples")
    for load in range(2):
        graph.store_triples(spark.createDataFrame([chunk(k) for k in range(load * 250, load * 250 + 250)], schema), table, path, 4)
    triples = spark.table(table)
    assert triples.count() == 500
    frontier = spark.createDataFrame([(f"e{k}",) for k in range(40)], "source_entity string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        step = triples.join(frontier, "source_entity", "left_semi")
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        edges = graph.hop_edges(triples, ["e1", "e2"], 4)
        got = {(r["source_entity"], r["hop"]) for r in edges.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    seen, want, level = {1, 2}, set(), [1, 2]
    for hop in range(1, 5):
        want |= {(f"e{k}", hop) for k in level}
        level = sorted({(k * 7 + 1) % 500 for k in level} - seen)
        seen |= set(level)
    assert got == want
    spark.sql(f"DROP TABLE {table}")


def test_hot_entities_leave_before_the_shuffle(spark):
    """One name holds half of all mentions: it is filtered by a bounded broadcast, and the index is that of plain counts."""
    data = [("t", "c", f"r{k}", ["Everywhere", f"Name{k % 50}", f"Rare{k}"]) for k in range(2000)]
    chunks = spark.createDataFrame(data, "tenant_id string, corpus_id string, row_id string, entity_names array<string>")
    index = graph.entity_index(chunks, max_freq=41)
    assert {(r["entity_name"], r["freq"]) for r in index.collect()} == {(f"Name{k}", 40) for k in range(50)} | {(f"Rare{k}", 1) for k in range(2000)}
    plan = graph.entity_index(chunks, max_freq=41)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "strategy=broadcast" in plan


def test_many_queries_meet_shards_of_rows(spark, monkeypatch):
    """Several thousand queries over several shards and blocks, none of them on the driver."""
    from tidemark.functions import vectors
    monkeypatch.setattr(vectors, "SHARD_ROWS", 300)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 700)
    draw = np.random.default_rng(4)
    points, asked = draw.standard_normal((1000, 4)).round(3), draw.standard_normal((3000, 4)).round(3)
    left = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(points)] + [("none", None), ("short", [1.0])], "row_id string, content_embedding array<double>")
    right = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(asked)] + [("odd", [1.0, 2.0])], "query_id string, vector array<double>")
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    got = {}
    for r in retrieval.knn(left, right, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["row_id"], r["distance"]))
    assert len(got) == 3000
    for q in range(0, 3000, 37):
        d = np.round(np.sqrt(((points - asked[q]) ** 2).sum(1)), 6)
        best = sorted((x, str(k)) for k, x in enumerate(d))[:3]
        assert [(i, x) for _, i, x in sorted(got[str(q)])] == [(i, x) for x, i in best]


def test_index_and_plain_chunks_score_alike(spark):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    data = [(str(k), " ".join(draw.choices(words, k=draw.randrange(0, 30))), [draw.random(), draw.random()]) for k in range(300)]
    chunks = spark.createDataFrame(data, "row_id string, content string, content_embedding array<double>")
    index = retrieval.build_index(chunks, work_path(spark, "index"))
    queries = [("a", "w1 w2 w39"), ("b", "w7"), ("c", "nothing")]
    table = spark.createDataFrame(queries, "query_id string, query string")
    def rows(df):
        return sorted(tuple(r) for r in df.collect())
    assert rows(retrieval.bm25(index, queries, 7)) == rows(retrieval.bm25(chunks, queries, 7))
    assert rows(retrieval.bm25_batch(index, table, 7)) == rows(retrieval.bm25_batch(chunks, table, 7)) != []
    assert rows(retrieval.rrf_inner(index.rows, "w1 w2", [0.5, 0.5], index=index)) == rows(retrieval.rrf_inner(chunks, "w1 w2", [0.5, 0.5]))
