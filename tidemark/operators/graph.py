"""Entity and triple indexes over chunks, neighbours, and traversals of the triple table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import work_path

SCOPE = ["tenant_id", "corpus_id"]
HEAVY = 1024  # bounds the names that are broadcast as too frequent
BUCKETS = 16  # default buckets of a stored triple table
TRIPLE_SCHEMA = "array<struct<source:string,relation:string,target:string>>"


def entity_mentions(chunks: DataFrame, min_length: int = 2, unit: str = "byte") -> DataFrame:
    """One row per entity mention, without nulls and very short names."""
    length = F.octet_length if unit == "byte" else F.length
    return (chunks.select(*SCOPE, "row_id", F.explode_outer("entity_names").alias("entity_name"))
            .filter(F.col("entity_name").isNotNull() & (length("entity_name") > min_length)))


def entity_index(chunks: DataFrame, max_freq: int = 500, unit: str = "byte") -> DataFrame:
    """Entities with fewer than ``max_freq`` mentions, their chunks and frequency.

    Frequencies come first, from partial counts; only the entities that stay are
    gathered, so a list never exceeds ``max_freq`` ids. Mentions of names that hold a
    ``1/HEAVY`` share of all or more, at most ``HEAVY`` names, are left out before the
    shuffle, so no hot name gathers in a task.
    """
    name = SCOPE + ["entity_name"]
    mentions = entity_mentions(chunks, unit=unit)
    counts = mentions.groupBy(*name).agg(F.count("*").alias("freq"))
    kept = counts.filter(F.col("freq") < max_freq)
    total = counts.agg(F.coalesce(F.sum("freq"), F.lit(0))).scalar()
    heavy = counts.filter((F.col("freq") >= max_freq) & (F.col("freq") * HEAVY >= total)).select(*name)
    return (mentions.join(F.broadcast(heavy), name, "left_anti").join(kept, name)
            .groupBy(*SCOPE, "entity_name", "freq").agg(F.array_sort(F.collect_set("row_id")).alias("chunk_ids")))


def triple_index(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, source_entity, relation_type, target_entity)`` from the JSON relationships.

    The outer generator spares a second parse for the emptiness test that the
    optimizer would otherwise put in front of it. A null text gives a null triple, so
    no filter on the text, which would compute a derived one twice, comes first.
    """
    return (chunks.select(*SCOPE, F.col("row_id").alias("chunk_id"), F.explode_outer(F.from_json("relationships", TRIPLE_SCHEMA)).alias("t"))
            .filter("t IS NOT NULL")
            .select(*SCOPE, "chunk_id", F.col("t.source").alias("source_entity"),
                    F.col("t.relation").alias("relation_type"), F.col("t.target").alias("target_entity")))


def store_triples(chunks: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Add the triples of newly loaded chunks to a table bucketed by source entity; the first load creates it.

    Steps along source entities then join bucket with bucket: the table is not shuffled, only the frontier is.
    """
    # The rebalance gathers a bucket's triples in few files and parts those of a hot source.
    rows = triple_index(chunks).hint("rebalance", "source_entity")
    rows.write.mode("append").format("parquet").bucketBy(buckets, "source_entity").option("path", path).saveAsTable(table)


def neighbour_pairs(chunks: DataFrame, d: int = 2, payload: Sequence[str] = ()) -> DataFrame:
    """Pairs of chunks of one document at most ``d`` positions apart.

    Each chunk asks for the exact positions it wants, so the band becomes an
    equi-join whose key contains the position: a very long document spreads over
    all tasks instead of meeting itself in one.
    """
    doc = SCOPE + ["doc_id"]
    offsets = F.array(*[F.lit(o) for o in range(-d, d + 1) if o])
    asking = (chunks.filter(F.col("doc_id").isNotNull())
              .select(*doc, F.col("row_id").alias("src_chunk"), F.col("chunk_index").alias("_at"), F.explode(offsets).alias("offset"))
              .withColumn("_index", F.col("_at") + F.col("offset")))
    answering = chunks.select(*doc, F.col("chunk_index").alias("_index"), F.col("row_id").alias("neighbor"), *payload)
    return (asking.join(answering, doc + ["_index"]).filter("src_chunk <> neighbor")
            .select(*SCOPE, "src_chunk", "offset", "neighbor", *payload))


def structural_neighbors(chunks: DataFrame, d: int = 2) -> DataFrame:
    return (neighbour_pairs(chunks, d).groupBy(*SCOPE, "src_chunk")
            .agg(F.array_sort(F.collect_set("neighbor")).alias("neighbor_chunks")))


def by_entity(chunks: DataFrame, entity: str, content_type: str | None = None) -> DataFrame:
    """Chunks that name an entity, optionally of one content type."""
    rows = chunks if content_type is None else chunks.filter(F.col("content_type") == content_type)
    return rows.filter(F.array_contains("entity_names", entity))


def expand(chunks: DataFrame, neighbors: DataFrame, seeds: DataFrame) -> DataFrame:
    """Chunks that are stored neighbours of the seed chunks (one hop)."""
    ids = (neighbors.join(seeds.select(F.col("row_id").alias("src_chunk")), "src_chunk", "left_semi")
           .select(F.explode("neighbor_chunks").alias("row_id")).distinct())
    return chunks.join(ids, "row_id", "left_semi")


def with_related_entities(chunks: DataFrame, d: int = 2) -> DataFrame:
    """``related_entity_names``: entities of the neighbouring chunks, at most 2·d short lists."""
    related = (neighbour_pairs(chunks, d, ["entity_names"])
               .groupBy(*SCOPE, F.col("src_chunk").alias("row_id"))
               .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entity_names")))).alias("related_entity_names")))
    return (chunks.join(related, SCOPE + ["row_id"], "left")
            .withColumn("related_entity_names", F.coalesce("related_entity_names", F.array().cast("array<string>"))))


def by_related(chunks: DataFrame, entity: str) -> DataFrame:
    return chunks.filter(F.array_contains("related_entity_names", entity))


def two_hop_overlap(chunks: DataFrame, entity: str) -> DataFrame:
    """Entities that share a chunk with ``entity``, with the number of shared chunks.

    The overlap of id lists is written as a semi-join on the chunk id.
    """
    mentions = entity_mentions(chunks).distinct()
    home = mentions.filter(F.col("entity_name") == entity).select(*SCOPE, "row_id")
    return (mentions.join(home, SCOPE + ["row_id"], "left_semi").filter(F.col("entity_name") != entity)
            .groupBy(*SCOPE, "entity_name").agg(F.count("*").alias("shared_chunks")))


def bfs2(triples: DataFrame, seed: str) -> DataFrame:
    """Targets within two hops of the seed with the chunk that states the edge."""
    hop1 = triples.filter(F.col("source_entity") == seed).select("target_entity", "chunk_id")
    frontier = hop1.select(F.col("target_entity").alias("source_entity")).distinct()
    hop2 = triples.join(frontier, "source_entity", "left_semi").select("target_entity", "chunk_id")
    return hop1.union(hop2).distinct()


def _seed_frame(spark: SparkSession, seeds: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select(F.col(seeds.columns[0]).alias("entity")).distinct()
    return spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "entity string")


def hop_edges(triples: DataFrame, seeds: Sequence[str] | DataFrame, hops: int = 2) -> DataFrame:
    """All edges met in ``hops`` breadth-first steps along source → target, with their first hop.

    Each hop appends its frontier, the nodes it reaches first, to a stored table; what
    earlier hops wrote is read, never written again. The triple table is only probed.
    """
    spark, folder = triples.sparkSession, work_path(triples.sparkSession, "visited")
    _seed_frame(spark, seeds).write.parquet(f"{folder}/hop=0")
    for hop in range(1, hops):
        frontier = spark.read.parquet(f"{folder}/hop={hop - 1}").withColumnRenamed("entity", "source_entity")
        seen = spark.read.parquet(*[f"{folder}/hop={h}" for h in range(hop)])
        reached = (triples.join(frontier, "source_entity", "left_semi")
                   .select(F.col("target_entity").alias("entity")).distinct().join(seen, "entity", "left_anti"))
        reached.write.parquet(f"{folder}/hop={hop}")
    starts = spark.read.schema("entity string, hop int").parquet(folder).select(
        F.col("entity").alias("source_entity"), (F.col("hop") + 1).alias("hop"))
    return triples.join(starts, "source_entity").select(
        "source_entity", "relation_type", "target_entity", "chunk_id", "hop")


def subgraph_edges(edges: DataFrame) -> DataFrame:
    """Edges without their chunk provenance, each once."""
    return edges.groupBy("source_entity", "relation_type", "target_entity").agg(F.min("hop").alias("hop"))


def subgraph_chunks(edges: DataFrame, max_chunks: int = 15) -> DataFrame:
    """Chunks that state the edges: nearer hops first, then more edges."""
    return (edges.groupBy("chunk_id").agg(F.min("hop").alias("hop"), F.count("*").alias("edges"))
            .orderBy("hop", F.desc("edges"), "chunk_id").limit(max_chunks))


def graph_nodes(chunks: DataFrame, triples: DataFrame, limit: int = 50) -> DataFrame:
    """The most mentioned entities with chunk and relationship counts and a display size."""
    seen = entity_mentions(chunks, min_length=0).select("entity_name", "row_id").distinct()
    counts = seen.groupBy("entity_name").agg(F.count("*").alias("chunk_count"))
    ends = F.array_distinct(F.array("source_entity", "target_entity"))
    related = (triples.select(F.explode(ends).alias("entity_name"))
               .groupBy("entity_name").agg(F.count("*").alias("relationship_count")))
    both = counts.join(related, "entity_name", "left").withColumn(
        "relationship_count", F.coalesce("relationship_count", F.lit(0)))
    weight = F.when(F.col("relationship_count") == 0, 1).otherwise(F.col("relationship_count"))
    shown = both.orderBy(F.desc("chunk_count"), "entity_name").limit(limit)
    return shown.select(
        F.replace("entity_name", F.lit(" "), F.lit("_")).alias("node_id"), F.col("entity_name").alias("name"), "chunk_count",
        "relationship_count", F.greatest(F.lit(3), F.least(F.lit(15), weight * 2)).cast("int").alias("size"))


def graph_links(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends are both among the (limited) nodes."""
    ids = nodes.select("node_id")

    def node(column: str) -> Column:
        return F.replace(F.col(column), F.lit(" "), F.lit("_"))
    edges = triples.select(node("source_entity").alias("source"), F.col("relation_type").alias("relation"),
                           node("target_entity").alias("target"))
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return edges.distinct().select("source", "relation", "target")


def graph_totals(chunks: DataFrame, triples: DataFrame) -> DataFrame:
    entities = entity_mentions(chunks, min_length=0).select("entity_name").distinct().agg(F.count("*").alias("entities"))
    return entities.withColumn("relationships", triples.agg(F.count("*")).scalar())


def related_entities(triples: DataFrame, entity: str) -> DataFrame:
    """Neighbours of an entity in the triple table, with direction."""
    def side(own: str, other: str, direction: str) -> DataFrame:
        return triples.filter(F.col(own) == entity).select(
            F.col(other).alias("entity_name"), F.col("relation_type").alias("relationship"),
            F.lit(direction).alias("direction"))
    return side("source_entity", "target_entity", "outgoing").union(
        side("target_entity", "source_entity", "incoming")).distinct()


def linked_chunks(chunks: DataFrame, entity: str) -> DataFrame:
    """Chunks that name the entity; multimodal ones are flagged."""
    return by_entity(chunks, entity).select(
        "row_id", "doc_id", "chunk_index", "content", "content_type", "page_number",
        F.col("content_type").isin("image", "table").alias("is_multimodal"))


def filter_nodes(nodes: DataFrame, query: str) -> DataFrame:
    return nodes.filter(F.lower("name").contains(query.lower()))


def filter_links(links: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """Edges with at least one end whose name contains the query."""
    hit = filter_nodes(nodes, query).select("node_id")
    by_source = links.join(hit, F.col("source") == F.col("node_id"), "left_semi")
    by_target = links.join(hit, F.col("target") == F.col("node_id"), "left_semi")
    return by_source.union(by_target).distinct()
