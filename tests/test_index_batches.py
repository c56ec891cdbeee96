"""Scores of a stored index, computed in batches, equal those of the plain path."""

from tidemark.operators import retrieval
from tidemark.session import work_path


def test_index_scores_equal_plain_scores(spark):
    texts = [f"{'red ' * (i % 4)}{'blue ' * (i % 3)}word{i % 7} x" for i in range(200)] + ["", None]
    chunks = spark.createDataFrame([(f"r{i:03d}", t) for i, t in enumerate(texts)], "row_id string, content string")
    index = retrieval.build_index(chunks, work_path(spark, "index"))
    asked = [("a", "red blue"), ("b", "word3"), ("c", "absent"), ("d", "")]
    plan = retrieval.bm25(index, asked, k=7)
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()  # no expression by token and row

    def seen(df):
        return sorted((r["query_id"], r["rank"], r["row_id"], round(r["score"], 6)) for r in df.collect())
    assert seen(plan) == seen(retrieval.bm25(chunks, asked, k=7))
    assert retrieval.bm25(index, [("d", "")], k=7).count() == 0
