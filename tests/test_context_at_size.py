"""Contexts across pages of a long document, and how often contents are shuffled."""

from tidemark.operators import corpus
from tidemark.sources import testmodel as m


def test_contexts_cross_pages_and_gaps(spark):
    """Positions 0 to 199 without every eleventh, and chunks without a place; F18: one exchange, no join."""
    schema = "tenant_id string, corpus_id string, row_id string, doc_id string, chunk_index int, content string"
    data = [("t", "c", f"{d}-{i}", d, i, f"{d}{i}") for d in ("a", "b") for i in range(200) if i % 11]
    data += [("t", "c", "n1", None, 1, "x"), ("t", "c", "n2", None, 2, "y"), ("t", "c", "n3", "a", None, "z"), (None, "c", "n4", "a", 5, "w")]
    got = {r["row_id"]: (r["before"], r["after"]) for r in corpus.context_window(spark.createDataFrame(data, schema)).collect()}
    there = {(r[3], r[4]): r[5] for r in data[:-4]}
    for _, _, row_id, d, i, _ in data[:-4]:
        assert got[row_id] == tuple([there[d, i + o] for o in side if (d, i + o) in there] for side in ((-2, -1), (1, 2)))
    assert all(got[f"n{k}"] == ([], []) for k in (1, 2, 3, 4)) and len(got) == len(data)


def test_contents_are_shuffled_once(spark, sf):
    plan = corpus.context_window(m.chunks_from_documents(m.table(spark, sf, "documents")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
