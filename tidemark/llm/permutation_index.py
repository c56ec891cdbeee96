"""Approximate nearest neighbours by inner product through a permutation index.

A shard of rows picks pivots that lie far apart, and every vector is represented by its nearest pivots in order. Pivot p's
inverted file posts the rows that hold p among their first pivots, with the place. For a query, the files of its own
pivots are added up: rows that share pivots at like places gain most, which is exactly the order of the footrule distance
between the truncated permutations. The nearest rows by footrule are then ranked by their true inner products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scale import top_per_group
from tidemark.llm import common

SHARD = 16_384  # rows of one shard of the index
QUERIES = 2048  # queries of one block
PIVOTS, PREFIX = 256, 64
SAMPLE = 4096  # rows of a shard among which its pivots are chosen
CANDIDATES = 2000  # rows of a shard that are reranked for a query, and all that tie with the last of them


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows, each the farthest from those before; fewer if the rest equal one of them."""
    square = np.einsum("ij,ij->i", rows, rows)
    picked = [int(square.argmax())]
    distance = np.full(len(rows), np.inf)
    while True:
        last = rows[picked[-1]]
        np.minimum(distance, square - 2 * (rows @ last) + last @ last, out=distance)
        distance[picked[-1]] = 0
        nearest = int(distance.argmax())
        if len(picked) == n or distance[nearest] <= 1e-12 * max(square[picked[0]], 1e-300):
            return rows[picked]
        picked.append(nearest)


class PermutationIndex:
    """Pivots and inverted files of one shard's vectors.

    For inner products all rows are first lifted onto a sphere by one more component, which is 0 for queries; then the
    greatest inner product is the least distance. The index sees vectors divided by a power of two, the ranking at the
    end sees them as they are.
    """

    def __init__(self, vectors: np.ndarray, pivots: int = PIVOTS, prefix: int = PREFIX, sample: int = SAMPLE):
        self.vectors, self.rows = vectors, len(vectors)
        self.shift = -int(np.frexp(np.abs(vectors).max())[1])
        lifted = np.ldexp(vectors, self.shift)
        square = np.einsum("ij,ij->i", lifted, lifted)
        lifted = np.column_stack([lifted, np.sqrt(np.maximum(square.max() - square, 0))])
        chosen = np.unique(np.linspace(0, self.rows - 1, min(sample, self.rows)).astype(np.int64))
        self.pivots = far_apart(lifted[chosen], pivots)
        self.prefix = min(prefix, len(self.pivots))
        order = self._order(lifted).ravel()
        place = np.argsort(order, kind="stable")
        self.posted = (place // self.prefix).astype(np.int32)
        self.weight = (self.prefix - place % self.prefix).astype(np.int16)
        self.file = np.searchsorted(order[place], np.arange(len(self.pivots) + 1))

    def _order(self, lifted: np.ndarray) -> np.ndarray:
        out = np.empty((len(lifted), self.prefix), np.int32)
        for k in range(0, len(lifted), 2048):
            near = lifted[k:k + 2048] @ self.pivots.T
            out[k:k + 2048] = np.argsort(-near, axis=1, kind="stable")[:, :self.prefix]
        return out

    def permutations(self, queries: np.ndarray) -> np.ndarray:
        """The first pivots of each query, nearest first."""
        lengths = np.abs(queries).max(1, keepdims=True)
        unit = np.ldexp(queries, -np.frexp(lengths)[1])  # the order of pivots does not depend on a query's length
        return self._order(np.column_stack([unit, np.zeros(len(queries))]))

    def candidates(self, permutation: np.ndarray, least: int) -> np.ndarray:
        """The ``least`` rows of least footrule distance to the permutation, and all rows as near as the last of them.

        With absent pivots placed behind the prefix, the distance is a constant less twice the sum, over shared pivots,
        of the smaller of the two weights (places counted from the end).
        """
        shared = np.zeros(self.rows, np.int32)
        for place, pivot in enumerate(permutation.tolist()):
            low, high = self.file[pivot], self.file[pivot + 1]
            shared[self.posted[low:high]] += np.minimum(self.weight[low:high], self.prefix - place)
        if self.rows <= least:
            return np.arange(self.rows)
        counts = np.cumsum(np.bincount(shared)[::-1])
        bound = len(counts) - 1 - int(np.searchsorted(counts, least))
        return np.flatnonzero(shared >= bound)

    def search(self, query: np.ndarray, permutation: np.ndarray, k: int, candidates: int, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the ``k`` best candidates, lower rows first among equals."""
        rows = self.candidates(permutation, candidates + len(without))
        if len(without):
            rows = rows[~np.isin(rows, without)]
        scores = (self.vectors[rows] * query).sum(1)
        if len(rows) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        best = np.lexsort((rows, -scores))[:k]
        return rows[best], scores[best]


def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """``id, size, values`` in doubles, of the vectors that take part."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    fit = F.forall("values", finite) & F.exists("values", lambda x: x != 0)
    return (vectors.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.size(vector).alias("size"), values.alias("values"))
            .filter(F.coalesce(fit, F.lit(False))))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, candidates: int = CANDIDATES, vector: str = "embedding",
            vec_id: str = "vec_id", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every``, the ``k`` rows of greatest inner product found.

    Every row is in the index of its shard; pivots come from at most ``SAMPLE`` of the shard's rows. A shard reranks
    ``candidates`` rows for a query, and all rows as near as the last of them. Scores are inner products in doubles of the
    original vectors; ties go to the smaller id. Vectors that are null, empty or zero or hold a null, NaN or infinite
    component take no part, nor do rows with a null id; vectors of other lengths are no candidates. Rows that
    repeat an id are candidates of their own, never for that id's query, which is asked once, with the shortest and then least of
    its vectors. Other columns take no part.
    """
    common.small_batches(vectors.sparkSession)
    rows = common.scratch(usable(vectors, vector, vec_id), "vectors")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("size", "values")).alias("q")) \
        .select(F.col("id").alias("query_id"), F.col("q.size").alias("size"), F.col("q.values").alias("asked"))
    n_rows, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n_rows // shard)), max(1, -(-n_asked // block))
    # Row shards meet query blocks: each cell is one group of bounded size. Shards take turns with the stored rows, so
    # that no id or vector, however often it is repeated, makes one larger than the others.
    left = (rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    cell = ["shard", "block", "size"]

    def answer(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if index.num_rows and queries.num_rows:
            index = index.sort_by([("id", "ascending")])
            ids = index["id"].to_numpy()
            found_in = PermutationIndex(_matrix(index["values"]))
            matrix = _matrix(queries["asked"])
            for query, values, permutation in zip(queries["query_id"].to_numpy(), matrix, found_in.permutations(matrix)):
                own = np.arange(np.searchsorted(ids, query), np.searchsorted(ids, query, "right"))
                found, scores = found_in.search(values, permutation, k, candidates, own)
                out[0].append(np.full(len(found), query))
                out[1].append(ids[found])
                out[2].append(scores)
        common.give_back()
        kinds = (("query_id", np.int64), ("vec_id", np.int64), ("score", np.float64))
        return pa.table({n: np.concatenate([np.zeros(0, t), *c]) for (n, t), c in zip(kinds, out)})

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(answer, "query_id long, vec_id long, score double")
    best = top_per_group(found, "query_id", [F.desc("score"), F.asc("vec_id")], k, ["vec_id"], rank="rank")
    return best.select("query_id", "rank", "vec_id", "score")
