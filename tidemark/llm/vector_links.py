"""Near-duplicate vectors by p-stable hashing of normalised vectors, confirmed by exact cosines.

Each of several tables projects a vector on Gaussian directions, shifts, and cuts by ``width``; the rounded projections
name its bucket. Vectors of one label and bucket are compared by their exact cosine, large buckets block against block.
A pair is counted in the first table where it meets, so no pair is emitted or stored: a task returns how many vectors
each one links with, and links enough to connect what belongs together. Equal vectors are one class throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.components import components

TABLES, PROJECTIONS, WIDTH = 24, 8, 1.5  # find a pair of cosine 0.93 with probability 0.98, one of 0.97 almost surely
BLOCK = 1024


def _dense(column) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def hashes(vectors: np.ndarray) -> np.ndarray:
    """Bucket of each vector in each table, as 32-bit numbers. Rows are hashed alike in any batch."""
    size = vectors.shape[1]
    draw = np.random.default_rng(size)
    directions = draw.standard_normal((size, TABLES * PROJECTIONS))
    shift = draw.uniform(0, WIDTH, TABLES * PROJECTIONS)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(vectors), TABLES, PROJECTIONS)
    out = np.zeros(cells.shape[:2], np.uint64)
    for k in range(PROJECTIONS):
        out = common.mix(out * common.BASE + cells[:, :, k] + np.uint64(k))
    return (out >> np.uint64(32)).astype("<u4")


def usable(vector: str):
    """Neither null nor zero, without null or non-finite components."""
    def finite(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Weights ``a, n`` and links ``a, b`` of one unit: the buckets, or block pairs of a bucket, that it holds."""
    table = table.sort_by([("bucket", "ascending"), ("own", "ascending"), ("id", "ascending")])
    bucket, own, ids = (table[c].to_numpy() for c in ("bucket", "own", "id"))
    count, size, number = table["count"].to_numpy(), table["size"].to_numpy(), table["table"].to_numpy()
    prints = np.frombuffer(b"".join(table["prints"].to_pylist()), "<u4").reshape(-1, TABLES)
    vectors = table["vector"].combine_chunks() if table.num_rows else None
    out_a, out_b, out_n = [], [], []
    bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(ids) else [0]
    for start, stop in zip(bounds[:-1], bounds[1:]):
        if stop - start < 2:
            continue
        x = _dense(vectors.slice(start, stop - start))
        length = np.linalg.norm(x, axis=1)
        blocks, split = own[start:stop], len(np.unique(own[start:stop])) > 1
        parent = list(range(stop - start))

        def root(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        t = int(number[start])
        linked = np.zeros(stop - start, np.int64)
        here, weight = prints[start:stop], count[start:stop]
        for k in range(0, stop - start, 256):
            cosine = (x[k:k + 256] @ x.T) / (length[k:k + 256, None] * length[None, :])
            a, b = np.nonzero(cosine >= threshold)
            a += k
            fresh = (a < b) & ((blocks[a] != blocks[b]) if split else True)
            a, b = a[fresh], b[fresh]
            first = ~(here[a, :t] == here[b, :t]).any(1) if t else np.ones(len(a), bool)
            a, b = a[first], b[first]
            np.add.at(linked, a, weight[b])
            np.add.at(linked, b, weight[a])
            for p, q in zip(a.tolist(), b.tolist()):
                p, q = root(p), root(q)
                if p != q:
                    parent[q] = p
                    out_a.append(int(ids[start + p]))
                    out_b.append(int(ids[start + q]))
                    out_n.append(None)
        hit = np.flatnonzero(linked)
        out_a += ids[start + hit].tolist()
        out_b += [None] * len(hit)
        out_n += linked[hit].tolist()
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})


def vector_links(vectors: DataFrame, threshold: float = 0.93, vector: str = "embedding", vec_id: str = "vec_id",
                 label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows link when their labels are equal and not null, their vectors have one length, and the cosine in double precision
    is at least ``threshold``. A vector that is null, empty or zero, or holds a null or non-finite component, links with
    nothing. ``n_links`` counts other rows linked directly, copies and rows that repeat an id included; ``component_id``
    is the least id reached, and its row is ``kept``. A row with a null id stays alone: component null, kept, though it
    counts for others' links no more than they for its own. Other columns take no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector")
    rows = rows.withColumn("part", takes_part).withColumn("a", F.when(takes_part, F.xxhash64("label", "vector"))) \
        .withColumn("b", F.when(takes_part, F.hash("vector", "label")))
    key = ["label", "a", "b"]
    # Equal vectors meet by two hashes before the shuffle; the class's vector is that of its least id.
    classes = common.scratch(rows.filter("part").groupBy(*key).agg(F.count("*").alias("count"), F.min_by("vector", "vec_id").alias("vector"),
                                                                    F.min("vec_id").alias("id")), "classes")

    def deal(batches):
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                part = batch.filter(pa.array(sizes == n))
                made = hashes(_dense(part.column(3)))
                label_hash = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                tables = np.arange(TABLES, dtype=np.uint64)
                name = common.mix((label_hash + np.uint64(n))[:, None] * common.BASE + (tables << np.uint64(32))[None, :] + made)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(3), pa.array([p.tobytes() for p in made], pa.binary()),
                                                  pa.array(list(name.view(np.int64)), pa.list_(pa.int64()))],
                                                 names=["id", "count", "vector", "prints", "buckets"])

    dealt = common.scratch(classes.select("id", "count", F.xxhash64("label").alias("label"), "vector").mapInArrow(
        deal, f"id long, count long, vector {classes.schema['vector'].dataType.simpleString()}, prints binary, buckets array<bigint>"), "prints")
    tables = dealt.select("id", F.posexplode("buckets").alias("table", "bucket"))
    sizes = tables.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK)
    pairs = (tables.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))))
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = F.when(F.col("size") <= BLOCK, F.pmod("bucket", F.lit(groups))).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    compared = (pairs.join(dealt.drop("buckets"), "id").withColumn("unit", unit).drop("other")
                .groupBy("unit").applyInArrow(lambda t: _compare(t, threshold), "a long, b long, n long"))
    compared = common.scratch(compared, "compared")
    reached = components(compared.filter("b is not null").select("a", "b"), "a", "b")
    direct = compared.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("near"))
    found = (classes.drop("vector").join(direct, "id", "left").join(reached, F.col("id") == F.col("vertex"), "left")
             .select(*key, (F.coalesce("near", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
    linked = rows.filter("part").drop("vector").join(found, key)
    alone = rows.filter("not part").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
    columns = ["vec_id", "n_links", "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns)).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
