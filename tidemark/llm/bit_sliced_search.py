"""Exact top-k inner products over a bit-sliced index of quantised vectors.

A shard of rows is turned into slices: for each attribute and each bit of its value, less the shard's least, one bitmap
over the rows. A query adds the slices it weighs by their place value: carry-save adders over whole bitmaps make the
slices of all rows' scores at once (negative weights take the complemented slices and a constant). The best rows come
from the most significant score slice downward, and rows left equal at the boundary are settled by their ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import common

SHARD = 65_536  # rows of one shard of the index
QUERIES = 512  # queries of one block
SCALE = 64


class Slices:
    """Bit-sliced index of the integer rows of one shard; bitmaps are 64-bit words over the rows in their order."""

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        self.low = values.min(0)
        shifted = values.view(np.uint64) - self.low.view(np.uint64)  # right for any two longs
        self.bits = [int(m).bit_length() for m in shifted.max(0)]
        self.words = -(-self.rows // 64)
        self.maps = [[self._pack((shifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(n)] for d, n in enumerate(self.bits)]
        self.all = self._pack(np.ones(self.rows, np.uint64))

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags.astype(np.uint8), bitorder="little")
        out[:len(packed)] = packed
        return out.view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of all scores, least significant first, and the constant to add."""
        constant = int((query.astype(object) * self.low.astype(object)).sum())
        levels: dict[int, list[np.ndarray]] = {}
        for weight, bits, maps in zip(query.tolist(), self.bits, self.maps):
            if weight < 0:
                maps = [~m & self.all for m in maps]
                constant += weight * ((1 << bits) - 1)
            for place in range(abs(weight).bit_length()):
                if abs(weight) >> place & 1:
                    for b, bitmap in enumerate(maps):
                        levels.setdefault(place + b, []).append(bitmap)
        out, place = [], 0
        while levels:
            stack = levels.pop(place, [])
            stack = np.array(stack) if stack else np.zeros((0, self.words), np.uint64)
            while len(stack) > 1:
                n = len(stack) // 3
                if n:
                    a, b, c = stack[:n], stack[n:2 * n], stack[2 * n:3 * n]
                    half = a ^ b
                    carry, total, rest = (a & b) | (half & c), half ^ c, stack[3 * n:]
                else:
                    carry, total, rest = stack[:1] & stack[1:], stack[:1] ^ stack[1:], stack[2:]
                levels.setdefault(place + 1, []).extend(carry)
                stack = np.concatenate([total, rest]) if len(rest) else total
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            place += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, without: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Rows of the k highest scores, lower rows first among equals, and their scores; ``without`` are left out."""
        slices, constant = self.scores(query)
        sure, tied = np.zeros(self.words, np.uint64), self.all.copy()
        for row in without:
            tied[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        have = 0
        for bitmap in reversed(slices):
            above = tied & bitmap
            more = int(np.bitwise_count(above).sum())
            if have + more > k:
                tied = above
            else:
                sure |= above
                have += more
                tied = tied & ~bitmap
                if have == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if have < k:
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[:k - have]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        found = [constant] * len(rows)
        for place, bitmap in enumerate(slices):
            for j, on in enumerate(((bitmap[word] >> bit) & np.uint64(1)).tolist()):
                found[j] += on << place
        return rows, found


def quantised(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """``id, size, values``: floor(64 * x) of each component of the vectors that take part; it must fit a long."""
    def long(x):
        x = x.cast("double") * SCALE
        fits = (x >= -float(1 << 63)) & (x < float(1 << 63))
        return F.when(fits, F.floor(x)).otherwise(F.raise_error(F.lit("a quantised component does not fit a long")).cast("long"))

    def finite(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    values = F.transform(vector, long)
    return (vectors.filter(F.coalesce(F.forall(vector, finite) & (F.size(vector) > 0), F.lit(False)) & F.col(vec_id).isNotNull())
            .select(F.col(vec_id).cast("long").alias("id"), F.size(vector).alias("size"), values.cast("array<bigint>").alias("values")))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every``, the ``k`` rows of highest inner product of the
    quantised vectors (all, if there are fewer), ties to the smaller id.

    A vector that is null or empty or holds a null, NaN or infinite component takes no part, nor does a row with a null id.
    A quantised component, or a score among the best, that does not fit a long is an error. Vectors of other lengths than the query's are no candidates for it. Rows that repeat an id are
    candidates of their own, never for that id's query, which is asked once. Other columns take no part.
    """
    spark = vectors.sparkSession
    rows = common.scratch(quantised(vectors, vector, vec_id), "quantised")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id", "size").agg(F.min("values").alias("values"))
    asked = asked.groupBy("id").agg(F.min_by("values", "size").alias("values"), F.min("size").alias("size"))
    n_rows, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n_rows // SHARD)), max(1, -(-n_asked // QUERIES))
    # A grid of row shards and query blocks: each cell is one task of bounded size.
    left = (rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    cell = ["shard", "block", "size"]

    def answer(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if index.num_rows and queries.num_rows:
            index = index.sort_by("id")
            ids = index["id"].to_numpy()
            slices = Slices(_matrix(index["values"]))
            for query, values in zip(queries["id"].to_numpy(), _matrix(queries["values"])):
                own = np.arange(np.searchsorted(ids, query), np.searchsorted(ids, query, "right"))
                found, scores = slices.top(values, k, own)
                if scores and not -(1 << 63) <= min(scores) <= max(scores) < 1 << 63:
                    raise OverflowError(f"a score of query {query} does not fit a long")
                out[0] += [int(query)] * len(found)
                out[1] += ids[found].tolist()
                out[2] += scores
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
