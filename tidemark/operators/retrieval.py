"""Keyword, vector and hybrid retrieval over chunks, and the comparison of rankings.

Chunks carry ``tenant_id, corpus_id, row_id, content`` and, where vectors are
searched, ``content_embedding``. Query texts and vectors are request parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import text, vectors
from tidemark.functions.fixed_values import ABSENT_INSIGHT_RANK, ABSENT_RANK, BEST_RANKS, KEYWORD_FLOOR, NEAR_RANKS, STRONG_MARGIN
from tidemark.functions.scale import top_per_group
from tidemark.session import cut_lineage

SCORE_DIGITS = 6
MATRIX_CELLS = 4_000_000  # bounds the memory of one matrix in a task


def scoped(chunks: DataFrame, tenant: str | None = None, corpus: str | None = None) -> DataFrame:
    """One tenant's corpus; the equality reaches the scan and prunes partitions."""
    for column, value in (("tenant_id", tenant), ("corpus_id", corpus)):
        if value is not None:
            chunks = chunks.filter(F.col(column) == value)
    return chunks


def query_vector(queries: DataFrame, query_id: str) -> list[float]:
    """The vector of one query; only its row leaves the table."""
    return [float(x) for x in queries.filter(F.col("query_id") == query_id).select("vector").first()[0]]


def keyword_match(chunks: DataFrame, query: str, how: str = "match_any", tenant: str | None = None,
                  corpus: str | None = None) -> DataFrame:
    return scoped(chunks, tenant, corpus).filter(text.MATCHERS[how]("content", query))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _saturation(tf: Column, length: Column, mean_length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / mean_length))


@dataclass(frozen=True)
class ChunkIndex:
    """Chunks as a load leaves them: ``rows`` with their ``tokens``, ``terms (term, df)`` in order, and the corpus totals."""

    rows: DataFrame
    terms: DataFrame
    count: int
    mean_length: float

    def statistics(self, terms: Sequence[str]) -> "Statistics":
        """Counts of a query's terms; the terms lie in order, so only their files' parts are read."""
        return Statistics(F.lit(float(self.count)), F.lit(self.mean_length), {t: F.lit(n) for t, n in self.frequencies(terms).items()})

    def frequencies(self, terms: Sequence[str]) -> dict[str, float]:
        """Chunks that hold each term."""
        found = {r["term"]: r["df"] for r in self.terms.filter(F.col("term").isin(list(terms))).collect()} if terms else {}
        return {t: float(found.get(t, 0)) for t in terms}


@dataclass(frozen=True)
class Statistics:
    """Number of chunks, their mean length and the chunks that hold each term, as columns."""

    n: Column
    mean_length: Column
    df: dict[str, Column]


def build_index(chunks: DataFrame, folder: str) -> ChunkIndex:
    """Store chunks with tokens, document frequencies and totals below ``folder``."""
    spark = chunks.sparkSession
    chunks.withColumn("tokens", text.tokens("content")).write.parquet(f"{folder}/rows")
    tokens = spark.read.parquet(f"{folder}/rows").select("tokens")
    (tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
     .orderBy("term").write.parquet(f"{folder}/terms"))
    tokens.agg(F.count("*").alias("count"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean_length")).write.parquet(f"{folder}/totals")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> ChunkIndex:
    totals = spark.read.parquet(f"{folder}/totals").first()
    return ChunkIndex(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/terms"), totals["count"], totals["mean_length"])


def _tokens(df: DataFrame) -> Column:
    return F.col("tokens") if "tokens" in df.columns else text.tokens("content")


def _hits(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Adds ``_len``, the number of tokens, and ``_hits``, the tokens that are query terms."""
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return df.withColumn("_toks", _tokens(df)).withColumns({
        "_len": F.size("_toks"), "_hits": F.filter("_toks", lambda t: F.array_contains(wanted, t))}).drop("_toks")


def _with_any(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold at least one query token."""
    if "tokens" not in chunks.columns:
        return chunks.filter(text.match_any("content", query))
    wanted = F.array(*[F.lit(t) for t in text.query_tokens(query)]).cast("array<string>")
    return chunks.filter(F.arrays_overlap("tokens", wanted))


def _counted(counted: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row of statistics from rows with ``_len`` and ``_hits``."""
    return counted.agg(
        F.count("*").cast("double").alias("n"), F.avg("_len").alias("mean_length"),
        *[F.count_if(F.array_contains("_hits", t)).cast("double").alias(f"df{i}") for i, t in enumerate(terms)])


def _model(per_query: list[tuple[str, list[str]]], known: Statistics) -> Column:
    """Mean length and, by query, the terms with their weights."""
    def weights(words: list[str]) -> Column:
        return F.array(*[F.struct(F.lit(w).alias("term"), _idf(known.n, known.df[w]).alias("idf")) for w in words])
    return F.struct(known.mean_length.alias("mean_length"), F.array(*[
        F.struct(F.lit(qid).alias("query_id"), weights(words).alias("terms")) for qid, words in per_query]).alias("queries"))


def _scored(rows: DataFrame, model: Column, k1: float, b: float) -> DataFrame:
    """``scores`` of rows with hits."""
    rows = rows.withColumn("_m", model)

    def score(query: Column) -> Column:
        def part(total: Column, t: Column) -> Column:
            tf = F.size(F.filter("_hits", lambda h: h == t["term"])).cast("double")
            return total + t["idf"] * _saturation(tf, F.col("_len"), F.col("_m")["mean_length"], k1, b)
        return F.round(F.aggregate(query["terms"], F.lit(0.0), part), SCORE_DIGITS)
    scores = F.transform(F.col("_m")["queries"], lambda q: F.struct(q["query_id"].alias("query_id"), score(q).alias("score")))
    return rows.withColumn("scores", scores).drop("_hits", "_len", "_m")


def _from_rows(counted: DataFrame, per_query: list[tuple[str, list[str]]], terms: list[str]) -> Column:
    """The model from counted rows, as a scalar subquery."""
    known = Statistics(F.col("n"), F.col("mean_length"), {t: F.col(f"df{i}") for i, t in enumerate(terms)})
    return _counted(counted, terms).select(_model(per_query, known)).scalar()


def _terms(queries: Sequence[tuple[str, str]]) -> tuple[list[tuple[str, list[str]]], list[str]]:
    per_query = [(qid, list(dict.fromkeys(text.query_tokens(q)))) for qid, q in queries]
    return per_query, list(dict.fromkeys(t for _, words in per_query for t in words))


def with_bm25(chunks: DataFrame, queries: Sequence[tuple[str, str]], k1: float = 1.2, b: float = 0.75,
              corpus: DataFrame | ChunkIndex | None = None) -> DataFrame:
    """Chunks with ``scores``: one ``(query_id, score)`` entry per query.

    The query terms are parameters, so their counts are array expressions in the
    scan. The corpus statistics come from a stored index, or are one aggregate row of ``corpus``
    (``chunks`` by default). Nothing is exploded.
    """
    per_query, terms = _terms(queries)
    if isinstance(corpus, ChunkIndex):
        model = _model(per_query, corpus.statistics(terms))
    else:
        of = chunks if corpus is None else corpus
        model = _from_rows(_hits(of.select("tokens" if "tokens" in of.columns else "content"), terms), per_query, terms)
    return _scored(_hits(chunks, terms), model, k1, b)


def bm25(chunks: DataFrame | ChunkIndex, queries: Sequence[tuple[str, str]], k: int = 5, k1: float = 1.2,
         b: float = 0.75) -> DataFrame:
    """The ``k`` best chunks per query text. Without an index, lengths and hits are stored once, for the statistics and the scores."""
    per_query, terms = _terms(queries)
    if isinstance(chunks, ChunkIndex):
        scored = _best_by_batch(chunks, per_query, terms, k, k1, b)
    else:
        hits = cut_lineage(_hits(chunks.select("row_id", "content"), terms).drop("content"))
        found = _scored(hits.filter(F.size("_hits") > 0), _from_rows(hits, per_query, terms), k1, b)
        # The outer form keeps the optimizer from testing the array's size first, which
        # would compute every score twice.
        scored = found.select("row_id", F.inline_outer("scores")).filter("score > 0")
    return top_per_group(scored, "query_id", [F.desc("score"), F.asc("row_id")], k, ["row_id"], rank="rank")


def _best_by_batch(index: ChunkIndex, per_query: list[tuple[str, list[str]]], terms: list[str], k: int, k1: float, b: float) -> DataFrame:
    """``row_id, query_id, score`` of the ``k`` best chunks of every batch of stored rows: a chunk × term matrix times a term × query one."""
    rows, mean = index.rows.select("row_id", "tokens"), index.mean_length or 1.0
    schema = f"row_id {rows.schema['row_id'].dataType.simpleString()}, query_id string, score double"
    if not terms:
        return rows.sparkSession.createDataFrame([], schema)
    df = np.array(list(index.frequencies(terms).values()))
    idf, names = np.log(1.0 + (index.count - df + 0.5) / (df + 0.5)), [qid for qid, _ in per_query]
    weights = np.array([[idf[i] if t in words else 0.0 for _, words in per_query] for i, t in enumerate(terms)])
    step = max(1, MATRIX_CELLS // max(weights.shape))

    def score(batches):
        wanted = pa.array(terms, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, tokens = part.column("row_id"), part.column("tokens")
                length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
                place = pc.fill_null(pc.index_in(tokens.flatten().cast(pa.string()), value_set=wanted), -1).to_numpy(zero_copy_only=False)
                cell = np.repeat(np.arange(part.num_rows), length) * len(terms) + place
                tf = np.bincount(cell[place >= 0], minlength=part.num_rows * len(terms)).reshape(part.num_rows, len(terms))
                with np.errstate(invalid="ignore"):  # an empty chunk is 0 / 0 where b is 1, and no score
                    tf = tf * (k1 + 1.0) / (tf + (k1 * (1.0 - b + b * length / mean))[:, None])
                scores, order = np.round(tf @ weights, SCORE_DIGITS), np.asarray(ids.to_pylist())
                for q, name in enumerate(names):
                    s = scores[:, q]
                    keep = np.flatnonzero(s > 0)
                    if len(keep) > 4 * k:
                        keep = keep[s[keep] >= -np.partition(-s[keep], k - 1)[k - 1]]
                    best = keep[np.lexsort((order[keep], -s[keep]))[:k]]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(best, pa.int64())), pa.array([name] * len(best), pa.string()), pa.array(s[best])],
                                                     names=["row_id", "query_id", "score"])
    return rows.mapInArrow(score, schema)


def bm25_batch(chunks: DataFrame | ChunkIndex, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 for a table of query texts ``(query_id, query)`` of any length: shards of chunks meet blocks of queries.

    Weights come from a join of the queries' terms with the document frequencies, and chunks
    are first reduced to terms that some query has; no query passes the driver. A cell is a chunk × term matrix multiplied with a term ×
    query one, and only the ``k`` best chunks per query leave it: frequent terms never multiply postings by queries.
    """
    if isinstance(chunks, ChunkIndex):
        lengths, frequency = chunks.rows.select("row_id", "tokens"), chunks.terms
        n, mean = F.lit(float(chunks.count)), chunks.mean_length
    else:
        lengths = cut_lineage(chunks.select("row_id", text.tokens("content").alias("tokens")))
        frequency = lengths.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        totals = lengths.agg(F.count("*").cast("double"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0))).first()
        n, mean = F.lit(totals[0]), totals[1]
    words = (queries.filter(F.col("query").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"),
                                                              F.explode(F.array_distinct(text.tokens("query"))).alias("term")))
    weighted = (words.join(frequency, "term").withColumn("idf", _idf(n, F.col("df").cast("double")))
                .groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs")))
    hits = (lengths.select("row_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
            .join(words.select("term").distinct(), "term", "left_semi")
            .groupBy("row_id", "length").agg(F.collect_list("term").alias("hits")))
    left, right = vectors.grid(hits, weighted, ["row_id"], "query_id")

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and asked.num_rows:
            vocabulary, place = np.unique(asked["terms"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            owner = np.repeat(np.arange(asked.num_rows), asked["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
            idf = asked["idfs"].combine_chunks().flatten().to_numpy()
            names = asked["query_id"].to_pylist()
            most = max(1, MATRIX_CELLS // max(1, len(vocabulary)))
            step = max(1, MATRIX_CELLS // max(len(vocabulary), min(most, len(names))))
            for first in range(0, len(names), most):
                inside = (owner >= first) & (owner < first + most)
                weights = np.zeros((len(vocabulary), min(most, len(names) - first)))
                weights[place[inside], owner[inside] - first] = idf[inside]
                for at in range(0, rows.num_rows, step):
                    part = rows.slice(at, step).combine_chunks()
                    ids, found = part["row_id"].combine_chunks(), part["hits"].combine_chunks()
                    tf = np.zeros((part.num_rows, len(vocabulary)))
                    terms = found.flatten().to_numpy(zero_copy_only=False).astype(str)
                    row = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy(zero_copy_only=False))
                    column = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                    known = vocabulary[column] == terms  # other blocks' terms are not this one's
                    np.add.at(tf, (row[known], column[known]), 1.0)
                    length = part["length"].to_numpy()
                    tf = tf * (k1 + 1.0) / (tf + (k1 * (1.0 - b + b * length / mean))[:, None])
                    scores = np.round(tf @ weights, SCORE_DIGITS)
                    order_ids = np.asarray(ids.to_pylist())
                    for q in range(scores.shape[1]):
                        s = scores[:, q]
                        keep = np.flatnonzero(s > 0)
                        if len(keep) > 4 * k:
                            keep = np.flatnonzero((s > 0) & (s >= -np.partition(-s, k - 1)[k - 1]))
                        best = keep[np.lexsort((order_ids[keep], -s[keep]))[:k]]
                        out[0] += [names[first + q]] * len(best)
                        out[1] += order_ids[best].tolist()
                        out[2] += s[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.string()), "row_id": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})

    cell = ["_shard", "_block"]
    scored = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(score, "query_id string, row_id string, score double")
    return top_per_group(scored, "query_id", [F.desc("score"), F.asc("row_id")], k, ["row_id"], rank="rank")


def knn(df: DataFrame, queries: Sequence[tuple[str, Sequence[float]]] | DataFrame, k: int = 5, row_id: str = "row_id",
        vector: str = "content_embedding", metric: str = "l2") -> DataFrame:
    """The ``k`` nearest rows per query vector, exact; ``queries`` may be a table ``(query_id, vector)`` of any length."""
    if isinstance(queries, DataFrame):
        found = vectors.nearest_for_table(df, row_id, vector, queries, k, metric)
    elif queries:
        found = vectors.nearest(df, row_id, vector, list(queries), k, metric)
    else:
        kind = df.schema[row_id].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"query_id string, {row_id} {kind}, distance double, rank int")
    return top_per_group(found, "query_id", [F.asc("distance"), F.asc(row_id)], k, [row_id], rank="rank")


def hybrid_weighted(chunks: DataFrame, query_text: str, query_vector: Sequence[float], where: Column | None = None,
                    max_distance: float = 0.3, keyword_weight: float = 0.3, vector_weight: float = 0.7,
                    limit: int = 10, index: ChunkIndex | None = None) -> DataFrame:
    """Structured filter, keyword filter, cosine filter, then a weighted score.

    The vector part enters as similarity (1 - distance), so that higher is better. Statistics are those of the stored
    ``index``, else of all ``chunks``.
    """
    rows = (chunks.filter(where) if where is not None else chunks)
    matched = _with_any(rows, query_text)
    near = (matched.withColumn("distance", vectors.distance_to("content_embedding", query_vector, "cosine"))
            .filter(F.col("distance") < max_distance))
    scored = with_bm25(near, [("q", query_text)], corpus=index or chunks)
    keyword = F.col("scores")[0]["score"]
    total = F.round(keyword * keyword_weight + (1.0 - F.col("distance")) * vector_weight, SCORE_DIGITS)
    return (scored.select("row_id", keyword.alias("keyword_score"), "distance", total.alias("score"))
            .orderBy(F.desc("score"), "row_id").limit(limit))


def rrf_inner(chunks: DataFrame, query_text: str, query_vector: Sequence[float], k: int = 60,
              limit: int = 10, index: ChunkIndex | None = None) -> DataFrame:
    """Reciprocal rank fusion where both ranks count all matching rows.

    A row ranked below ``k + 2·limit`` in both lists cannot reach the result, since
    each of the best ``limit`` rows of one list already scores more than
    1/(k + limit). So only the heads of the two lists are candidates, and their
    ranks are found by counting the rows before each candidate, without a global sort.
    """
    matched = _with_any(chunks, query_text)
    # Three narrow columns of the matching rows, scored once and read several times.
    rows = cut_lineage(with_bm25(matched, [("q", query_text)], corpus=index or chunks).select(
        "row_id", vectors.distance_to("content_embedding", query_vector).alias("distance"),
        (-F.col("scores")[0]["score"]).alias("loss")))
    by_vector, by_text = F.struct("distance", "row_id"), F.struct("loss", "row_id")
    head = k + 2 * limit
    candidates = (rows.orderBy("distance", "row_id").limit(head)
                  .union(rows.orderBy("loss", "row_id").limit(head)).distinct())

    def ranked(place: Column, name: str) -> DataFrame:
        # At most 2·head places, so the array is bounded by parameters.
        places = candidates.agg(F.sort_array(F.collect_set(place))).scalar()
        slot = rows.select(place.alias("p")).withColumn("places", places).select(
            F.size(F.filter("places", lambda c: c < F.col("p"))).alias("slot"))
        running = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = slot.groupBy("slot").agg(F.count("*").alias("n")).select("slot", F.sum("n").over(running).alias(name))
        at = candidates.select("row_id", place.alias("p")).withColumn("places", places).select(
            "row_id", (F.array_position("places", F.col("p")) - 1).cast("int").alias("slot"))
        # Rows in the slots up to the candidate's own lie at or before it in list order.
        return at.join(F.broadcast(upto), "slot").select("row_id", name)
    fused = (candidates.join(ranked(by_vector, "vec_rank"), "row_id").join(ranked(by_text, "bm25_rank"), "row_id")
             .withColumn("rrf", F.lit(1.0) / (F.col("vec_rank") + k) + F.lit(1.0) / (F.col("bm25_rank") + k)))
    return fused.select("row_id", "vec_rank", "bm25_rank", "rrf").orderBy(F.desc("rrf"), "row_id").limit(limit)


def rrf_outer(vector_list: DataFrame, keyword_list: DataFrame, k: int = 60, missing: int = 1000) -> DataFrame:
    """Fusion of two ranked candidate lists; a row absent from one list counts as rank ``missing``."""
    a = vector_list.select("query_id", "row_id", F.col("rank").alias("vector_rank"))
    b = keyword_list.select("query_id", "row_id", F.col("rank").alias("bm25_rank"))
    both = a.join(b, ["query_id", "row_id"], "full_outer")

    def share(rank: str) -> Column:
        return F.lit(1.0) / (F.coalesce(rank, F.lit(missing)) + k)
    return both.withColumn("rrf", share("vector_rank") + share("bm25_rank"))


def search_all(chunks: DataFrame | ChunkIndex, queries: Sequence[tuple[str, str, Sequence[float]]], k: int = 5,
               depth: int = 20) -> DataFrame:
    """Vector, keyword and hybrid lists of the same queries: ``(query_id, method, rank, row_id, score)``.

    The two lists, queries × depth rows each, are stored once, as several branches read them.
    """
    rows = chunks.rows if isinstance(chunks, ChunkIndex) else chunks
    vector_list = cut_lineage(knn(rows, [(qid, v) for qid, _, v in queries], depth))
    keyword_list = cut_lineage(bm25(chunks, [(qid, t) for qid, t, _ in queries], depth))
    fused = top_per_group(rrf_outer(vector_list, keyword_list), "query_id", [F.desc("rrf"), F.asc("row_id")],
                          k, ["row_id"], rank="rank", salts=1)
    shaped = [
        (vector_list.filter(F.col("rank") <= k), "vector", F.round(1.0 / (1.0 + F.col("distance")), SCORE_DIGITS)),
        (keyword_list.filter(F.col("rank") <= k), "bm25", F.col("score")),
        (fused, "hybrid", F.col("rrf")),
    ]
    out = None
    for df, method, score in shaped:
        part = df.select("query_id", F.lit(method).alias("method"), "rank", "row_id", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def rank_table(results: DataFrame) -> DataFrame:
    """One row per query and chunk with its rank in each list (null when absent)."""
    def rank(method: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col("rank")))
    return results.groupBy("query_id", "row_id").agg(
        rank("vector").alias("vector_rank"), rank("bm25").alias("bm25_rank"), rank("hybrid").alias("hybrid_rank"))


def compare_rankings(results: DataFrame, k: int = 5) -> DataFrame:
    """How the hybrid head overlaps with the two single-method heads, per query."""
    top = rank_table(results).filter(F.col("hybrid_rank") <= k)
    v, b = F.coalesce("vector_rank", F.lit(ABSENT_RANK)), F.coalesce("bm25_rank", F.lit(ABSENT_RANK))
    return top.groupBy("query_id").agg(
        F.count("*").alias("hybrid_results"),
        F.count_if(b <= k).alias("from_bm25"), F.count_if(v <= k).alias("from_vector"),
        F.count_if((b <= k) & (v <= k)).alias("from_both"),
        F.count_if(b > k).alias("not_in_bm25"), F.count_if(v > k).alias("not_in_vector"),
        F.count_if((b > k) & (v <= k)).alias("missed_by_bm25"), F.count_if((v > k) & (b <= k)).alias("missed_by_vector"),
        F.count_if(b < v).alias("bm25_better"), F.count_if(v < b).alias("vector_better"),
        F.count_if(v == b).alias("equal_rank"))


def explain_rank(ranks: DataFrame) -> DataFrame:
    """Why the hybrid rank differs, by ordered rules, and the movement against the vector list."""
    v, b, h = (F.coalesce(c, F.lit(ABSENT_RANK)) for c in ("vector_rank", "bm25_rank", "hybrid_rank"))
    rules = [
        ((v <= BEST_RANKS) & (b > NEAR_RANKS), "semantic_without_keywords", "semantic"),
        ((b <= BEST_RANKS) & (v > NEAR_RANKS), "keywords_only", "keyword"),
        ((v <= NEAR_RANKS) & (b <= NEAR_RANKS) & (h == 1), "strong_in_both", "balanced"),
        ((h < v) & (h < b), "boosted_by_fusion", "balanced"),
        ((h >= F.least(v, b)) & (h <= F.greatest(v, b)), "averaged_by_fusion", "balanced"),
        (v < b, "semantic_wins", "semantic"),
        (b < v, "keywords_win", "keyword"),
    ]
    reason, kind = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, why, what in rules[1:]:
        reason, kind = reason.when(test, why), kind.when(test, what)
    moved = F.coalesce(F.col("vector_rank") - F.col("hybrid_rank"), F.lit(0))
    return ranks.select(
        "*", reason.otherwise("similar").alias("reason"), kind.otherwise("unknown").alias("reason_type"),
        F.abs(moved).alias("delta"), F.when(moved > 0, "up").when(moved < 0, "down").otherwise("same").alias("direction"))


def explain_score(scores: DataFrame) -> DataFrame:
    """Insight per score column pair and rank triple, with a fixed margin and floor."""
    v, b = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("bm25_score", F.lit(0.0))
    vr, br, hr = (F.coalesce(c, F.lit(ABSENT_INSIGHT_RANK)) for c in ("vector_rank", "bm25_rank", "hybrid_rank"))
    vector = F.when(v > b + STRONG_MARGIN, "strong").when(v > b, "moderate").otherwise("present")
    keyword = (F.when(b > v + STRONG_MARGIN, "strong").when(b > v, "good").when(b < KEYWORD_FLOOR, "missing_keywords").otherwise("moderate"))
    between = ((hr > vr) & (hr < br)) | ((hr < vr) & (hr > br))
    hybrid = (F.when((hr < vr) & (hr < br), "boosted").when(between, "balanced")
              .when((hr == vr) | (hr == br), "maintained").otherwise("combined"))
    return scores.select("*", vector.alias("vector_insight"), keyword.alias("bm25_insight"), hybrid.alias("hybrid_insight"))


def summarise_movement(explained: DataFrame) -> DataFrame:
    """Improved and dropped counts per query and the row that fusion promoted to the top."""
    promoted = ((F.col("hybrid_rank") == 1) & (F.coalesce("vector_rank", F.lit(0)) != 1)
                & (F.coalesce("bm25_rank", F.lit(0)) != 1))
    improved, dropped = F.count_if(F.col("direction") == "up"), F.count_if(F.col("direction") == "down")
    winner = F.max(F.when(promoted, F.col("row_id")))
    return explained.groupBy("query_id").agg(
        F.count("*").alias("results"), improved.alias("improved"), dropped.alias("dropped"), winner.alias("promoted")
    ).withColumn("verdict", F.when(F.col("promoted").isNotNull(), "promoted")
                 .when(F.col("improved") > F.col("dropped"), "improved").otherwise("consistent"))
