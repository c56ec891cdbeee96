"""Chunks are cut in one pass, and their triples are computed once."""

from tidemark.operators import graph
from tidemark.sources import testmodel as m


def test_chunks_are_windows_of_characters(spark):
    """Line ends, characters beyond 16 bits, full and short last windows, empty and null texts."""
    texts = [None, "", "a" * 400, "b" * 401, "\n\r" * 450, "\U0001F600é" * 500]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {(r["doc_key"], r["chunk_index"]): r["content"] for r in m.chunks_from_documents(docs).collect()}
    want = {(i, k): t and t[k * 400:k * 400 + 400] for i, t in enumerate(texts) for k in range(max(1, -(-len(t or "") // 400)))}
    assert got == want


def test_triples_are_computed_once(spark, sf):
    """A filter on the text of the triples computed names and JSON again, before the cut text was kept (F7)."""
    plan = graph.triple_index(m.chunks(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and plan.count("array_distinct") == 1
