"""Connected components of a link table: links around a vertex meet and contract, until all are stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common


def _forest(batches):
    """Links of one task reduced to one link from each vertex to the least vertex it reaches within the task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = parent[min(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


SALTS = 8  # tasks over which the links that point at one vertex are dealt
LINKS = 100_000  # links of one task, on average


def _meet(edges: DataFrame) -> DataFrame:
    """Links so dealt over tasks that those from a vertex meet all those that point at it; each task keeps a forest of its own.

    Links that point at a vertex are shared out by their other end, those that start from it go to every share.
    """
    spark = edges.sparkSession
    out = edges.select("u", "v", F.col("u").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    into = edges.select("u", "v", F.col("v").alias("at"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).alias("salt"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() * (SALTS + 1) // LINKS))
    return out.unionByName(into).repartition(tasks, "at", "salt").select("u", "v").mapInArrow(_forest, "u long, v long").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether no vertex points at two others, and none that is pointed at points on: then the links are components."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    open_ = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return open_.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex, component_id`` for every vertex that some link ``a - b`` touches; the id is the least vertex reached.

    In each round the links around every vertex meet in a task, which points all it connects at the least of them, so chains shorten by
    half; a vertex of very many links is dealt over several tasks. Rounds are written to the shared folder and end
    when all links are stars. Links with a null end or of a vertex to itself say nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = common.scratch(edges.mapInArrow(_forest, "u long, v long").distinct(), "links")
    while not _all_stars(edges):
        after = common.scratch(_meet(edges), "links")
        common.drop_scratch(edges)
        edges = after
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component_id")).distinct())
