"""Vector expressions. Batches reach numpy through Arrow, as one matrix per batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIGITS = 6

def matrix(values: pa.Array) -> np.ndarray:
    """A list array of equal lengths as float64 rows."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = np.unique(values.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or np.isnan(lengths).any():
        raise ValueError("vectors of one batch differ in length")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def by_length(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of each vector length; null and empty vectors are left out."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        yield at, matrix(values.take(pa.array(at)))


def l2_rows(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def cosine_rows(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine distance, 1 - similarity."""
    return 1.0 - (x @ q) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


METRICS = {"l2": l2_rows, "cosine": cosine_rows}


def distance_to(column: str, vector: Sequence[float], metric: str = "l2") -> Column:
    """Distance of each row's vector to one query vector; null where the row has none of that length."""
    q, rows = np.asarray(vector, dtype=np.float64), METRICS[metric]

    @F.arrow_udf("double")
    def distance(v: pa.Array) -> pa.Array:
        out = np.full(len(v), np.nan)
        for at, x in by_length(v):
            if x.shape[1] == len(q):
                out[at] = np.round(rows(x, q), DIGITS)
        return pa.array(out, pa.float64(), mask=np.isnan(out))
    return distance(F.col(column))


def _best(d: np.ndarray, order_ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` least distances, smaller ids first among equals."""
    if len(d) > 4 * k:
        # Everything up to the k-th distance, ties included, then the exact order.
        keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        keep = np.arange(len(d))
    return keep[np.lexsort((order_ids[keep], d[keep]))[:k]]


def _sortable(ids: pa.Array) -> np.ndarray:
    return np.asarray(ids.to_pylist()) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False)


def _winners(ids: pa.Array, x: np.ndarray, names: Sequence[str], targets: Sequence[np.ndarray], k: int, metric: str) -> tuple[list, pa.Array, np.ndarray]:
    """Names, ids and distances of the ``k`` best rows of ``x`` for each target."""
    order_ids, rows, out_q, out_i, out_d = _sortable(ids), METRICS[metric], [], [np.zeros(0, np.int64)], [np.zeros(0)]
    for name, q in zip(names, targets):
        d = np.round(rows(x, q), DIGITS)
        best = _best(d, order_ids, k)
        out_q += [name] * len(best)
        out_i.append(best)
        out_d.append(d[best])
    return out_q, ids.take(pa.array(np.concatenate(out_i))), np.concatenate(out_d)


def nearest(df: DataFrame, row_id: str, vector: str, queries: Sequence[tuple[str, Sequence[float]]], k: int,
            metric: str = "l2") -> DataFrame:
    """Per Arrow batch, the ``k`` best rows for each query: ``(query_id, row_id, distance)``.

    Only batch winners leave the task, never a row per (query, vector) pair. Rows whose vector is null or of another
    length than the queries' take no part.
    """
    id_type = df.schema[row_id].dataType.simpleString()
    schema = f"query_id string, {row_id} {id_type}, distance double"
    names = [str(name) for name, _ in queries]
    targets = [np.asarray(v, dtype=np.float64) for _, v in queries]
    width = len(targets[0])
    if any(len(q) != width for q in targets):
        raise ValueError("query vectors differ in length")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _winners(batch.column(0), matrix(batch.column(1)), names, targets, k, metric)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), found[1], pa.array(found[2])],
                                                 names=["query_id", row_id, "distance"])

    source = df.select(row_id, vector).filter(F.size(vector) == width)
    return source.mapInArrow(scan, schema)


#: Rows of a shard and queries of a block that meet in one task.
SHARD_ROWS, BLOCK_QUERIES = 8192, 2048


def grid(rows: DataFrame, queries: DataFrame, spread_by: Sequence[str], query_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with ``_shard`` and ``_block``, such that every row meets every query in exactly one cell of bounded size."""
    shards = F.greatest(F.lit(1), F.ceil(rows.agg(F.count("*")).scalar() / SHARD_ROWS))
    blocks = F.greatest(F.lit(1), F.ceil(queries.agg(F.count("*")).scalar() / BLOCK_QUERIES))
    zero = F.lit(0).cast("long")
    left = (rows.withColumn("_shard", F.pmod(F.xxhash64(*spread_by), shards))
            .withColumn("_block", F.explode(F.sequence(zero, blocks - 1))))
    right = (queries.withColumn("_block", F.pmod(F.xxhash64(query_id), blocks))
             .withColumn("_shard", F.explode(F.sequence(zero, shards - 1))))
    return left, right


def nearest_for_table(df: DataFrame, row_id: str, vector: str, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """As ``nearest``, for a table ``(query_id, vector)`` of any length: shards of rows meet blocks of queries.

    No query passes the driver; a task holds one shard and one block and emits the ``k`` best rows of each query.
    """
    kind = df.schema[row_id].dataType
    schema = f"query_id string, {row_id} {kind.simpleString()}, distance double"
    rows = df.select(row_id, F.col(vector).cast("array<double>").alias("_x")).filter(F.size("_x") > 0).withColumn("_width", F.size("_x"))
    asked = (queries.select(F.col("query_id").cast("string").alias("_name"), F.col("vector").cast("array<double>").alias("_q"))
             .filter(F.size("_q") > 0).withColumn("_width", F.size("_q")))
    left, right = grid(rows, asked, [row_id], "_name")
    cell = ["_shard", "_block", "_width"]

    def meet(index: pa.Table, block: pa.Table) -> pa.Table:
        ids = index[row_id].combine_chunks()
        x = matrix(index["_x"]) if index.num_rows else np.zeros((0, 1))
        named = zip(*[block["_name"].to_pylist(), matrix(block["_q"])]) if index.num_rows and block.num_rows else ()
        names, targets = zip(*named) if named else ((), ())
        found = _winners(ids, x, names, targets, k, metric)
        return pa.table({"query_id": pa.array(found[0], pa.string()), row_id: found[1], "distance": found[2]})

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, schema)


def vector_stats(column: str, first: int = 512, near_zero: float = 0.01) -> Column:
    """Mean, range, population deviation and sum; norm and sparsity over the first dimensions; null without a vector."""
    @F.arrow_udf("struct<mean:double,min:double,max:double,std_dev:double,total:double,l2_norm:double,sparsity_pct:double>")
    def stats(v: pa.Array) -> pa.Array:
        names = ["mean", "min", "max", "std_dev", "total", "l2_norm", "sparsity_pct"]
        out, known = np.zeros((len(names), len(v))), np.zeros(len(v), dtype=bool)
        for at, x in by_length(v):
            head = x[:, :first]
            out[:, at] = [x.mean(axis=1), x.min(axis=1), x.max(axis=1), x.std(axis=1), x.sum(axis=1),
                          np.sqrt((head * head).sum(axis=1)), (np.abs(head) < near_zero).mean(axis=1) * 100]
            known[at] = True
        return pa.StructArray.from_arrays([pa.array(p) for p in out], names=names, mask=pa.array(~known))
    return stats(F.col(column))


def vector_sample(column: str, buckets: int = 128) -> Column:
    """At most ``buckets`` means of equal runs (a trailing rest is ignored), scaled to 0..1."""
    @F.arrow_udf("array<double>")
    def sample(v: pa.Array) -> pa.Array:
        out = np.full(len(v), None, dtype=object)
        for at, x in by_length(v):
            step = max(1, x.shape[1] // buckets)
            n = min(buckets, x.shape[1] // step)
            means = x[:, :n * step].reshape(len(x), n, step).mean(axis=2)
            low, high = means.min(axis=1, keepdims=True), means.max(axis=1, keepdims=True)
            span = np.where(high - low == 0, 1.0, high - low)
            for i, scaled in zip(at, (means - low) / span):
                out[i] = scaled
        return pa.array(out.tolist(), pa.list_(pa.float64()))
    return sample(F.col(column))


def l2(a: Column | str, b: Column | str) -> Column:
    """Distance between two vector columns."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))
