"""Registered retrieval queries. The oracle scores exploded postings and full cross products."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import retrieval as R
from tidemark.plans.register import Registry
from tidemark.plans.views_sql import SEP, sql
from tidemark.session import work_path
from tidemark.sources import testmodel as m
from tidemark.sources.kept import kept

register = Registry()

TEXTS = [("0", "the thing and token"), ("1", "der die und zeit"), ("2", "que para los datos"), ("3", "le la des error")]
RRF_TEXT, RRF_LABEL = "token error zeit", "3"

_TERMS = "(VALUES " + ", ".join(f"('{q}', '{w}')" for q, t in TEXTS for w in t.split()) + ") q(query_id, term)"


def _scores(terms: str, source: str = "chunks") -> str:
    """CTEs up to ``bm25(query_id, row_id, score)``."""
    return f""", toks AS (SELECT row_id, list_filter(string_split_regex(lower(content), '{SEP}+'), lambda x: x <> '') AS t FROM {source}),
st AS (SELECT count(*) AS n, avg(len(t)) AS m FROM toks),
tf AS (SELECT row_id, l, term, count(*) AS tf FROM (SELECT row_id, len(t) AS l, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm25 AS (SELECT query_id, row_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score
  FROM {terms} JOIN df USING (term) JOIN tf USING (term), st GROUP BY 1, 2)
"""


def _ranked(source: str, order: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, row_id) AS INTEGER) AS rank
  FROM {source}) WHERE rank <= {k}"""


_VECTOR = """, dist AS (SELECT query_id, row_id, round(list_distance(v, q), 6) AS distance FROM embedded, query_vectors
  WHERE query_id IN ('0', '1', '2', '3'))
"""


def _index(spark, sf):
    """The stored chunks with tokens, vectors and statistics."""
    def load():
        folder = work_path(spark, "chunk-index")
        # Entities and triples have stores of their own; here they would cost more than the tokens.
        R.build_index(m.embedded_chunks(spark, sf).drop("entity_names", "relationships"), folder)
        return folder
    return R.open_index(spark, kept(spark, "chunk_index", sf, load))


def _vector(spark, sf, label):
    return R.query_vector(m.query_vectors(spark, sf), label)


@register("r1_keyword_match", sql("chunks", f"""
SELECT row_id, doc_id FROM chunks WHERE corpus_id = 'en' AND tenant_id = 'src3'
  AND list_has_all(string_split_regex(lower(content), '{SEP}+'), ['the', 'and'])"""))
def r1(spark, sf):
    return R.keyword_match(m.chunks(spark, sf), "the and", "match_all", "src3", "en").select("row_id", "doc_id")


@register("r2_bm25", sql("chunks", _scores(_TERMS) + _ranked("bm25", "score DESC", 5)))
def r2(spark, sf):
    return R.bm25(_index(spark, sf), TEXTS, k=5)


@register("r2_bm25_batch", sql("chunks", _scores(
    f"(SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest(list_filter(string_split_regex(lower(text), '{SEP}+'), "
    "lambda x: x <> '')) AS term FROM benchmark)") + _ranked("bm25", "score DESC", 3)))
def r2_batch(spark, sf):
    asked = m.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return R.bm25_batch(_index(spark, sf), asked, k=3)


@register("r3_knn_l2", sql("query_vectors", """
SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings, query_vectors))
WHERE rank <= 10"""))
def r3(spark, sf):
    return R.knn(m.vectors(spark, sf), m.query_vectors(spark, sf), 10, "vec_id", "embedding")


@register("r4_hybrid_weighted", sql("embedded query_vectors", _scores("(VALUES ('q', 'the'), ('q', 'token')) q(query_id, term)") + """
SELECT row_id, score AS keyword_score, distance, round(score * 0.3 + (1 - distance) * 0.7, 6) AS score FROM (
  SELECT row_id, round(1 - list_cosine_similarity(v, q), 6) AS distance FROM embedded, query_vectors
  WHERE query_id = '3' AND content_type = 'text') JOIN bm25 USING (row_id)
WHERE distance < 0.7 ORDER BY round(score * 0.3 + (1 - distance) * 0.7, 6) DESC, row_id LIMIT 10"""))
def r4(spark, sf):
    index = _index(spark, sf)
    return R.hybrid_weighted(index.rows, "the token", _vector(spark, sf, "3"), F.col("content_type") == "text", max_distance=0.7, index=index)


@register("r5_rrf_inner", sql("embedded query_vectors", _scores(
    "(VALUES ('q', 'token'), ('q', 'error'), ('q', 'zeit')) q(query_id, term)") + """
, matched AS (SELECT row_id, score, round(list_distance(v, q), 6) AS distance
  FROM embedded JOIN bm25 USING (row_id) JOIN query_vectors qv ON qv.query_id = '3')
SELECT row_id, vec_rank, bm25_rank, 1.0::DOUBLE / (60 + vec_rank) + 1.0::DOUBLE / (60 + bm25_rank) AS rrf FROM (
  SELECT row_id, row_number() OVER (ORDER BY distance, row_id) AS vec_rank,
         row_number() OVER (ORDER BY score DESC, row_id) AS bm25_rank FROM matched)
ORDER BY rrf DESC, row_id LIMIT 10"""))
def r5(spark, sf):
    index = _index(spark, sf)
    return R.rrf_inner(index.rows, RRF_TEXT, _vector(spark, sf, RRF_LABEL), index=index)


_LISTS = _VECTOR + _scores(_TERMS) + f""", vl AS ({_ranked("dist", "distance", 20)}), kl AS ({_ranked("bm25", "score DESC", 20)}),
fused AS (SELECT query_id, row_id, vl.rank AS vector_rank, kl.rank AS bm25_rank,
  1.0::DOUBLE / (coalesce(vl.rank, 1000) + 60) + 1.0::DOUBLE / (coalesce(kl.rank, 1000) + 60) AS rrf
  FROM vl FULL JOIN kl USING (query_id, row_id)),
results AS (SELECT query_id, 'vector' AS method, rank, row_id, round(1 / (1 + distance), 6) AS score FROM vl WHERE rank <= 5
  UNION ALL SELECT query_id, 'bm25', rank, row_id, score FROM kl WHERE rank <= 5
  UNION ALL SELECT query_id, 'hybrid', rank, row_id, rrf FROM ({_ranked("fused", "rrf DESC", 5)})),
ranks AS (SELECT query_id, row_id, max(rank) FILTER (method = 'vector') AS vector_rank, max(rank) FILTER (method = 'bm25') AS bm25_rank,
  max(rank) FILTER (method = 'hybrid') AS hybrid_rank FROM results GROUP BY 1, 2),
filled AS (SELECT *, coalesce(vector_rank, 999) AS v, coalesce(bm25_rank, 999) AS b, coalesce(hybrid_rank, 999) AS h FROM ranks),
explained AS (SELECT query_id, row_id, vector_rank, bm25_rank, hybrid_rank,
  CASE WHEN v <= 2 AND b > 3 THEN 'semantic_without_keywords' WHEN b <= 2 AND v > 3 THEN 'keywords_only'
       WHEN v <= 3 AND b <= 3 AND h = 1 THEN 'strong_in_both' WHEN h < v AND h < b THEN 'boosted_by_fusion'
       WHEN h BETWEEN least(v, b) AND greatest(v, b) THEN 'averaged_by_fusion' WHEN v < b THEN 'semantic_wins'
       WHEN b < v THEN 'keywords_win' ELSE 'similar' END AS reason,
  coalesce(abs(vector_rank - hybrid_rank), 0) AS delta,
  CASE WHEN vector_rank > hybrid_rank THEN 'up' WHEN vector_rank < hybrid_rank THEN 'down' ELSE 'same' END AS direction FROM filled)
"""


def _queries(spark, sf):
    asked = m.query_vectors(spark, sf).filter(F.col("query_id").isin([qid for qid, _ in TEXTS])).select("query_id", "vector")
    vectors = {qid: [float(x) for x in v] for qid, v in asked.collect()}  # one row per text
    return [(qid, words, vectors[qid]) for qid, words in TEXTS]


def _results(spark, sf):
    """The lists of R7, stored once for the reports on them."""
    def load():
        folder = work_path(spark, "search-all")
        R.search_all(_index(spark, sf), _queries(spark, sf)).write.parquet(folder)
        return folder
    return spark.read.parquet(kept(spark, "search_all", sf, load))


@register("r6_rrf_outer", sql("embedded query_vectors", _LISTS + "SELECT * FROM fused"))
def r6(spark, sf):
    index, asked = _index(spark, sf), _queries(spark, sf)
    return R.rrf_outer(R.knn(index.rows, [(q, v) for q, _, v in asked], 20), R.bm25(index, [(q, t) for q, t, _ in asked], 20))


@register("r7_search_all", sql("embedded query_vectors", _LISTS + "SELECT * FROM results"))
def r7(spark, sf):
    return R.search_all(_index(spark, sf), _queries(spark, sf))


@register("r8_compare_rankings", sql("embedded query_vectors", _LISTS + """
SELECT query_id, count(*) AS hybrid_results, count(*) FILTER (b <= 5) AS from_bm25, count(*) FILTER (v <= 5) AS from_vector,
  count(*) FILTER (b <= 5 AND v <= 5) AS from_both, count(*) FILTER (b > 5) AS not_in_bm25, count(*) FILTER (v > 5) AS not_in_vector,
  count(*) FILTER (b > 5 AND v <= 5) AS missed_by_bm25, count(*) FILTER (v > 5 AND b <= 5) AS missed_by_vector,
  count(*) FILTER (b < v) AS bm25_better, count(*) FILTER (v < b) AS vector_better, count(*) FILTER (v = b) AS equal_rank
FROM filled WHERE hybrid_rank <= 5 GROUP BY 1"""))
def r8(spark, sf):
    return R.compare_rankings(_results(spark, sf))


@register("r9_explain_rank", sql("embedded query_vectors", _LISTS + """
SELECT *, CASE reason WHEN 'semantic_without_keywords' THEN 'semantic' WHEN 'semantic_wins' THEN 'semantic' WHEN 'keywords_only' THEN 'keyword'
  WHEN 'keywords_win' THEN 'keyword' WHEN 'similar' THEN 'unknown' ELSE 'balanced' END AS reason_type FROM explained"""))
def r9(spark, sf):
    return R.explain_rank(R.rank_table(_results(spark, sf)))


@register("r10_explain_score", sql("embedded query_vectors", _LISTS + """
SELECT query_id, row_id,
  CASE WHEN vs > bs + 0.15 THEN 'strong' WHEN vs > bs THEN 'moderate' ELSE 'present' END AS vector_insight,
  CASE WHEN bs > vs + 0.15 THEN 'strong' WHEN bs > vs THEN 'good' WHEN bs < 0.7 THEN 'missing_keywords' ELSE 'moderate' END AS bm25_insight,
  CASE WHEN h < v AND h < b THEN 'boosted' WHEN (h > v AND h < b) OR (h < v AND h > b) THEN 'balanced' WHEN h = v OR h = b THEN 'maintained'
       ELSE 'combined' END AS hybrid_insight
FROM (SELECT query_id, row_id, coalesce(max(score) FILTER (method = 'vector'), 0) AS vs,
        coalesce(max(score) FILTER (method = 'bm25'), 0) / 10 AS bs, coalesce(max(rank) FILTER (method = 'vector'), 99) AS v,
        coalesce(max(rank) FILTER (method = 'bm25'), 99) AS b, coalesce(max(rank) FILTER (method = 'hybrid'), 99) AS h
      FROM results GROUP BY 1, 2)"""))
def r10(spark, sf):
    def score(method):
        return F.max(F.when(F.col("method") == method, F.col("score")))
    results = _results(spark, sf)
    scores = results.groupBy("query_id", "row_id").agg(
        score("vector").alias("vector_score"), (score("bm25") / 10).alias("bm25_score"))
    both = R.rank_table(results).join(scores, ["query_id", "row_id"])
    return R.explain_score(both).select("query_id", "row_id", "vector_insight", "bm25_insight", "hybrid_insight")


@register("r11_summarise_movement", sql("embedded query_vectors", _LISTS + """
SELECT *, CASE WHEN promoted IS NOT NULL THEN 'promoted' WHEN improved > dropped THEN 'improved' ELSE 'consistent' END AS verdict
FROM (SELECT query_id, count(*) AS results, count(*) FILTER (direction = 'up') AS improved, count(*) FILTER (direction = 'down') AS dropped,
  max(row_id) FILTER (hybrid_rank = 1 AND coalesce(vector_rank, 0) <> 1 AND coalesce(bm25_rank, 0) <> 1) AS promoted
  FROM explained GROUP BY 1)"""))
def r11(spark, sf):
    return R.summarise_movement(R.explain_rank(R.rank_table(_results(spark, sf))))
