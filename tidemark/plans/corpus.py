"""Registered graph and corpus queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text, vectors
from tidemark.functions.fixed_values import ENTITY_NOISE, ENTITY_TYPES, STOP_WORDS
from tidemark.operators import corpus as C, graph as G
from tidemark.operators.retrieval import scoped
from tidemark.plans.register import Registry
from tidemark.plans.views_sql import sql
from tidemark.session import work_path
from tidemark.sources import testmodel as m
from tidemark.sources.kept import kept

register = Registry()

_MENTIONS = """, mentions AS (SELECT tenant_id, corpus_id, row_id, unnest(entity_names) AS entity_name FROM chunks),
named AS (SELECT * FROM mentions WHERE strlen(entity_name) > 2)
"""
SEED, SECOND = "Eriner", "Nicht"  # entity names that occur at every scale


def _triples(spark, sf):
    """The stored triple table that the graph queries read."""
    def load():
        name = f"triples_{uuid.uuid4().hex}"
        G.store_triples(m.chunks(spark, sf), name, work_path(spark, "triples"))
        return name
    return spark.table(kept(spark, "triples", f"{sf}/documents.parquet", load))


def _join(column: str, sep: str = "|"):
    return F.array_join(column, sep).alias(column)


@register("r12_entity_index", sql("chunks", _MENTIONS + """
SELECT tenant_id, corpus_id, entity_name, string_agg(DISTINCT row_id, '|' ORDER BY row_id) AS chunk_ids, count(*) AS freq
FROM named GROUP BY 1, 2, 3 HAVING count(*) < 6"""))
def r12(spark, sf):
    index = G.entity_index(m.chunks(spark, sf), max_freq=6)
    return index.select("tenant_id", "corpus_id", "entity_name", "freq", _join("chunk_ids"))


@register("r13_triple_index", sql("triples", "SELECT * FROM triples"))
def r13(spark, sf):
    return G.triple_index(m.chunks(spark, sf))


_NEAR = """, near AS (SELECT a.tenant_id, a.corpus_id, a.row_id AS src_chunk, b.row_id AS neighbor, b.chunk_index - a.chunk_index AS off,
    b.content, b.entity_names AS names FROM chunks a JOIN chunks b ON a.tenant_id = b.tenant_id AND a.corpus_id = b.corpus_id
    AND a.doc_id = b.doc_id AND abs(a.chunk_index - b.chunk_index) BETWEEN 1 AND 2)
"""


@register("r14_structural_neighbors", sql("chunks", _NEAR + """
SELECT tenant_id, corpus_id, src_chunk, string_agg(neighbor, '|' ORDER BY neighbor) AS neighbor_chunks FROM near GROUP BY 1, 2, 3"""))
def r14(spark, sf):
    near = G.structural_neighbors(m.chunks(spark, sf))
    return near.select("tenant_id", "corpus_id", "src_chunk", _join("neighbor_chunks"))


@register("r15_by_entity", sql("chunks", f"""
SELECT row_id, content_type FROM chunks WHERE list_contains(entity_names, '{SEED}') AND content_type = 'text'"""))
def r15(spark, sf):
    return G.by_entity(m.chunks(spark, sf), SEED, "text").select("row_id", "content_type")


@register("r16_expand", sql("chunks", _NEAR + f"""
SELECT row_id, doc_id FROM chunks WHERE row_id IN (
  SELECT neighbor FROM near WHERE src_chunk IN (SELECT row_id FROM chunks WHERE list_contains(entity_names, '{SEED}')))"""))
def r16(spark, sf):
    chunks = m.chunks(spark, sf)
    return G.expand(chunks, G.structural_neighbors(chunks), G.by_entity(chunks, SEED)).select("row_id", "doc_id")


@register("r17_by_related", sql("chunks", _NEAR + f"""
SELECT DISTINCT src_chunk AS row_id FROM near WHERE list_contains(names, '{SEED}')"""))
def r17(spark, sf):
    return G.by_related(G.with_related_entities(m.chunks(spark, sf)), SEED).select("row_id")


@register("r18_two_hop_overlap", sql("chunks", _MENTIONS + f"""
SELECT n.tenant_id, n.corpus_id, n.entity_name, count(DISTINCT n.row_id) AS shared_chunks FROM named n
WHERE n.entity_name <> '{SEED}' AND EXISTS (SELECT 1 FROM named s WHERE s.entity_name = '{SEED}' AND s.row_id = n.row_id
  AND s.tenant_id = n.tenant_id AND s.corpus_id = n.corpus_id) GROUP BY 1, 2, 3"""))
def r18(spark, sf):
    return G.two_hop_overlap(m.chunks(spark, sf), SEED)


@register("r19_bfs2", sql("triples", f"""
, hop1 AS (SELECT target_entity, chunk_id FROM triples WHERE source_entity = '{SEED}')
SELECT * FROM hop1 UNION SELECT t.target_entity, t.chunk_id FROM triples t JOIN hop1 h ON t.source_entity = h.target_entity"""))
def r19(spark, sf):
    return G.bfs2(_triples(spark, sf), SEED)


_HOPS = f""", s AS (SELECT unnest(['{SEED}', '{SECOND}']) AS e),
n1 AS (SELECT DISTINCT target_entity AS e FROM triples WHERE source_entity IN (SELECT e FROM s) AND target_entity NOT IN (SELECT e FROM s)),
visited AS (SELECT e, 1 AS hop FROM s UNION ALL SELECT e, 2 FROM n1),
edges AS (SELECT source_entity, relation_type, target_entity, chunk_id, hop FROM triples JOIN visited ON source_entity = e)
"""


@register("r20_subgraph_edges", sql("triples", _HOPS + """
SELECT source_entity, relation_type, target_entity, min(hop) AS hop FROM edges GROUP BY 1, 2, 3"""))
def r20(spark, sf):
    return G.subgraph_edges(G.hop_edges(_triples(spark, sf), [SEED, SECOND], hops=2))


@register("r20_subgraph_chunks", sql("triples", _HOPS + """
SELECT chunk_id, min(hop) AS hop, count(*) AS edges FROM edges GROUP BY 1 ORDER BY 2, 3 DESC, 1 LIMIT 15"""))
def r20_chunks(spark, sf):
    return G.subgraph_chunks(G.hop_edges(_triples(spark, sf), [SEED, SECOND], hops=2))


_NODES = """, seen AS (SELECT DISTINCT row_id, unnest(entity_names) AS name FROM chunks),
cc AS (SELECT name, count(*) AS chunk_count FROM seen WHERE name <> '' GROUP BY 1),
rc AS (SELECT name, count(*) AS rels FROM (SELECT source_entity AS name FROM triples
  UNION ALL SELECT target_entity FROM triples WHERE target_entity <> source_entity) GROUP BY 1),
nodes AS (SELECT replace(name, ' ', '_') AS node_id, name, chunk_count, coalesce(rels, 0) AS relationship_count,
  CAST(greatest(3, least(15, 2 * CASE WHEN coalesce(rels, 0) = 0 THEN 1 ELSE rels END)) AS INTEGER) AS size
  FROM cc LEFT JOIN rc USING (name) ORDER BY chunk_count DESC, name LIMIT 50),
links AS (SELECT DISTINCT replace(source_entity, ' ', '_') AS source, relation_type AS relation, replace(target_entity, ' ', '_') AS target
  FROM triples WHERE replace(source_entity, ' ', '_') IN (SELECT node_id FROM nodes) AND replace(target_entity, ' ', '_') IN (SELECT node_id FROM nodes))
"""


def _graph(spark, sf):
    chunks = m.chunks(spark, sf)
    triples = _triples(spark, sf)
    return chunks, triples, G.graph_nodes(chunks, triples)


@register("r21_graph_nodes", sql("triples", _NODES + "SELECT * FROM nodes"))
def r21(spark, sf):
    return _graph(spark, sf)[2]


@register("r21_graph_links", sql("triples", _NODES + "SELECT * FROM links"))
def r21_links(spark, sf):
    _, triples, nodes = _graph(spark, sf)
    return G.graph_links(triples, nodes)


@register("r21_graph_totals", sql("triples", _NODES + """
SELECT count(*) AS entities, (SELECT count(*) FROM triples) AS relationships FROM cc"""))
def r21_totals(spark, sf):
    chunks, triples, _ = _graph(spark, sf)
    return G.graph_totals(chunks, triples)


@register("r22_related_entities", sql("triples", f"""
SELECT DISTINCT target_entity AS entity_name, relation_type AS relationship, 'outgoing' AS direction FROM triples WHERE source_entity = '{SEED}'
UNION SELECT DISTINCT source_entity, relation_type, 'incoming' FROM triples WHERE target_entity = '{SEED}'"""))
def r22(spark, sf):
    return G.related_entities(_triples(spark, sf), SEED)


@register("r22_linked_chunks", sql("chunks", f"""
SELECT row_id, doc_id, chunk_index, content, content_type, page_number, content_type IN ('image', 'table') AS is_multimodal
FROM chunks WHERE list_contains(entity_names, '{SEED}')"""))
def r22_chunks(spark, sf):
    return G.linked_chunks(m.chunks(spark, sf), SEED)


@register("r23_graph_filter", sql("triples", _NODES + """
SELECT * FROM links WHERE source IN (SELECT node_id FROM nodes WHERE contains(lower(name), 'en'))
  OR target IN (SELECT node_id FROM nodes WHERE contains(lower(name), 'en'))"""))
def r23(spark, sf):
    _, triples, nodes = _graph(spark, sf)
    return G.filter_links(G.graph_links(triples, nodes), nodes, "EN")


@register("r24_corpus_stats", sql("embedded", """
SELECT tenant_id, corpus_id, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(v) AS vectors FROM embedded GROUP BY 1, 2"""))
def r24(spark, sf):
    return C.corpus_stats(m.embedded_chunks(spark, sf))


@register("r25_document_stats", sql("chunks", """
SELECT tenant_id, corpus_id, doc_id, count(*) AS chunk_count, max(page_number) AS pages,
  substring(arg_min(content, chunk_index), 1, 200) AS preview, bool_or(content_type = 'image') AS has_images,
  bool_or(content_type = 'table') AS has_tables FROM chunks GROUP BY 1, 2, 3"""))
def r25(spark, sf):
    return C.document_stats(m.chunks(spark, sf))


@register("r26_reassemble", sql("chunks", r"""
SELECT tenant_id, corpus_id, doc_id, CAST(chunk_index // 30 AS INTEGER) AS page,
  coalesce(string_agg(content, E'\n\n' ORDER BY chunk_index) FILTER (content_type = 'text'), '') AS text,
  coalesce(string_agg(row_id, '|' ORDER BY chunk_index) FILTER (content_type IN ('image', 'table')), '') AS assets,
  CAST(count(*) FILTER (content_type = 'image') AS INTEGER) AS image_count FROM chunks GROUP BY 1, 2, 3, 4"""))
def r26(spark, sf):
    whole = C.reassemble(m.chunks(spark, sf), page_chunks=30)
    return whole.withColumn("assets", F.array_join("assets", "|"))


@register("r27_find_text", sql("chunks", """
SELECT row_id, doc_id FROM chunks WHERE contains(lower(content), 'token') OR contains(doc_id, 'token')"""))
def r27(spark, sf):
    return C.find_text(m.chunks(spark, sf), "Token", ["content", "doc_id"]).select("row_id", "doc_id")


@register("r28_by_type", sql("chunks", """
SELECT doc_id, content_type, count(*) AS chunks, CAST(list_position(['text', 'image', 'table', 'code', 'formula'], content_type) AS INTEGER)
  AS type_order FROM chunks GROUP BY 1, 2"""))
def r28(spark, sf):
    return C.by_type(m.chunks(spark, sf))


@register("r28_multimodal_counts", sql("chunks", """
SELECT doc_id, page_number, count(*) FILTER (content_type = 'image') AS image_count, count(*) FILTER (content_type = 'table') AS table_count,
  count(*) FILTER (content_type = 'formula') AS formula_count FROM chunks GROUP BY 1, 2"""))
def r28_counts(spark, sf):
    return C.multimodal_counts(m.chunks(spark, sf))


_KINDS = "[" + ", ".join(f"'{t}'" for t in ENTITY_TYPES) + "]"


@register("r28_entities_by_type", sql("chunks", f"""
SELECT {_KINDS}[(i - 1) % 4 + 1] AS entity_type, count(*) AS mentions, count(DISTINCT entity_names[i]) AS names
FROM chunks, UNNEST(range(1, least(len(entity_names), 8) + 1)) AS t(i) GROUP BY 1"""))
def r28_entities(spark, sf):
    return C.entities_by_type(m.chunks(spark, sf))


@register("r29_extract_entities", sql("chunks", f"""
SELECT row_id, coalesce(array_to_string(list_transform(entity_names[1:8], lambda x, i: x || ':' || {_KINDS}[(i - 1) % 4 + 1]), '|'), '') AS entities FROM chunks"""))
def r29(spark, sf):
    found = F.transform(text.extract_entities("content"), lambda e: F.concat_ws(":", e["name"], e["type"]))
    return m.chunks(spark, sf).select("row_id", F.array_join(found, "|").alias("entities"))


@register("r30_extract_keywords", r"""
SELECT doc_id, coalesce(array_to_string(list_transform(w[1:6], lambda x: regexp_replace(x, '[^a-z]', '', 'g')), '|'), '') AS keywords
FROM (SELECT doc_id, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS w FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 5) AS ws FROM documents))""")
def r30(spark, sf):
    return m.table(spark, sf, "documents").select("doc_id", F.array_join(text.extract_keywords("text"), "|").alias("keywords"))


@register("r31_query_terms", r"""
SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 2 AND x NOT IN (""" + ", ".join(
    f"'{w}'" for w in STOP_WORDS) + r""")), '|') AS terms FROM benchmark""")
def r31(spark, sf):
    return m.table(spark, sf, "benchmark").select("item_id", F.array_join(text.query_terms("text"), "|").alias("terms"))


@register("r32_preview", """
SELECT doc_id, regexp_replace(regexp_replace(substring(text, 1, 250), '(token)', '【\\1】', 'gi'), '(the)', '【\\1】', 'gi')
  || CASE WHEN length(text) > 250 THEN '...' ELSE '' END AS preview FROM documents""")
def r32(spark, sf):
    return m.table(spark, sf, "documents").select("doc_id", text.preview("text", ["token", "the"]).alias("preview"))


@register("r33_clean_entities", sql("chunks", f"""
SELECT row_id, coalesce(array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i)[1:12], '|'), '') AS entities FROM (
  SELECT row_id, list_filter(entity_names, lambda x: length(x) BETWEEN 3 AND 35 AND NOT regexp_matches(x, '{ENTITY_NOISE}')) AS e FROM chunks)"""))
def r33(spark, sf):
    return m.chunks(spark, sf).select("row_id", F.array_join(text.clean_entities("entity_names"), "|").alias("entities"))


@register("r34_token_budget", sql("chunks", """
SELECT *, CASE WHEN total_tokens > 6000 THEN 'high' WHEN total_tokens > 4000 THEN 'medium' ELSE 'low' END AS level, total_tokens <= 8192 AS fits
FROM (SELECT content_type AS source, CAST(sum((length(content) + 3) // 4) AS BIGINT) AS tokens,
  CAST(245 + sum(sum((length(content) + 3) // 4)) OVER () AS BIGINT) AS total_tokens FROM chunks GROUP BY 1)"""))
def r34(spark, sf):
    return C.token_budget(m.chunks(spark, sf), "content_type")


@register("r35_vector_stats", """
SELECT vec_id, round(list_avg(v), 6) AS mean, list_min(v) AS min, list_max(v) AS max, round(list_stddev_pop(v), 6) AS std_dev,
  round(list_sum(v), 6) AS total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l2_norm,
  round(len(list_filter(v, lambda x: abs(x) < 0.01)) * 100.0::DOUBLE / len(v), 6) AS sparsity_pct
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def r35(spark, sf):
    stats = m.vectors(spark, sf).select("vec_id", vectors.vector_stats("embedding").alias("s")).select("vec_id", "s.*")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev", "total", "l2_norm", "sparsity_pct")})


@register("r36_vector_sample", """
SELECT vec_id, i - 1 AS bucket, round((s[i] - list_min(s)) / (list_max(s) - list_min(s)), 6) AS level FROM (
  SELECT vec_id, list_transform(range(0, 16), lambda b: list_avg(v[b * 4 + 1 : b * 4 + 4])) AS s
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), UNNEST(range(1, 17)) AS t(i)""")
def r36(spark, sf):
    sampled = m.vectors(spark, sf).select("vec_id", vectors.vector_sample("embedding", 16).alias("s"))
    return sampled.select("vec_id", F.posexplode("s").alias("bucket", "level")).select(
        "vec_id", F.col("bucket").cast("long").alias("bucket"), F.round("level", 6).alias("level"))


@register("r37_citations", sql("answers", r"""
, marks AS (SELECT conv_id, turn, m, i FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '!\[[^\]]*\]\[(?:IMG-\d+|\d+)\]|\[(?:\d+|IMG-\d+|TABLE-\d+|EQ-\d+)\]') AS ms FROM answers),
  UNNEST(range(1, len(ms) + 1)) AS t(i), LATERAL (SELECT ms[i] AS m))
SELECT conv_id, turn, CAST(i AS INTEGER) AS position, CASE WHEN m[1] = '!' THEN 'ref_image' ELSE 'citation' END AS kind,
  regexp_extract(m, '\[([^\[\]]*)\]$', 1) AS ref_id, regexp_extract(m, '^!\[([^\]]*)\]', 1) AS alt_text FROM marks"""))
def r37(spark, sf):
    return C.citations(m.answers(spark, sf), ["conv_id", "turn"])


@register("r38_context_window", sql("chunks", _NEAR + """
SELECT c.row_id, c.content, coalesce(string_agg(n.content, '|' ORDER BY off) FILTER (off < 0), '') AS before,
  coalesce(string_agg(n.content, '|' ORDER BY off) FILTER (off > 0), '') AS after
FROM chunks c LEFT JOIN near n ON c.row_id = n.src_chunk GROUP BY 1, 2"""))
def r38(spark, sf):
    return C.context_window(m.chunks(spark, sf)).select("row_id", "content", _join("before"), _join("after"))


@register("r39_by_content_type", sql("chunks", "SELECT row_id, content FROM chunks WHERE content_type = 'image'"))
def r39(spark, sf):
    return C.by_content_type(m.chunks(spark, sf), "image").select("row_id", "content")


@register("r40_scoped", sql("chunks", "SELECT row_id, chunk_index FROM chunks WHERE tenant_id = 'src7' AND corpus_id = 'fr'"))
def r40(spark, sf):
    return scoped(m.chunks(spark, sf), "src7", "fr").select("row_id", "chunk_index")
