"""Registered change-capture, ingest and lifecycle jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import ingest as W
from tidemark.operators.digests import RangedTable
from tidemark.plans.register import Registry
from tidemark.plans.views_sql import sql
from tidemark.session import cut_lineage, work_path
from tidemark.sources import testmodel as m
from tidemark.sources.parted import PartedTable

register = Registry()


def _replica(spark, sf):
    """A copy that is behind by key and still holds orders the source has lost."""
    orders = m.order_headers(spark, sf)
    mark = orders.agg((F.max("order_id") * 9 / 10).cast("long")).scalar()
    return orders.filter(F.col("order_id") <= mark)


def _source(spark, sf):
    """Orders that have line items; the others were deleted at the source."""
    lines = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id")).distinct()
    orders = m.order_headers(spark, sf).withColumn(
        "order_status", F.when(F.col("updated_at") > F.col("created_at"), "shipped").otherwise(F.col("order_status")))
    return orders.join(lines, "order_id", "left_semi")


_PAIR = """, top AS (SELECT CAST(trunc(max(order_id) * 9 / 10) AS BIGINT) AS k FROM order_headers),
replica AS (SELECT * FROM order_headers WHERE order_id <= (SELECT k FROM top)),
source AS (SELECT * REPLACE (CASE WHEN updated_at > created_at THEN 'shipped' ELSE order_status END AS order_status)
  FROM order_headers WHERE order_id IN (SELECT l_orderkey FROM lineitem)),
newer AS (SELECT * FROM source WHERE order_id > (SELECT max(order_id) FROM replica) ),
changes AS (SELECT * FROM source WHERE updated_at > (SELECT max(updated_at) FROM source) - INTERVAL 30 DAY AND updated_at > created_at),
grown AS (SELECT * FROM replica UNION ALL SELECT * FROM newer),
gone AS (SELECT order_id FROM grown WHERE order_id NOT IN (SELECT order_id FROM source))
"""


def _since(source):
    return times.ago(source.agg(F.max("updated_at")).scalar(), 30, "day")


@register("w1_incremental_new", sql("order_headers", _PAIR + """
SELECT order_id, partner_id, order_status, CAST(taxful_total_price AS DOUBLE) AS price, order_date FROM newer"""))
def w1(spark, sf):
    new = W.incremental_new(_source(spark, sf), _replica(spark, sf), "order_id")
    return new.select("order_id", "partner_id", "order_status",
                      F.col("taxful_total_price").cast("double").alias("price"), "order_date")


@register("w2_incremental_items", """
WITH items AS (SELECT l_orderkey * 8 + l_linenumber AS item_id, l_partkey, l_extendedprice FROM lineitem),
mark AS (SELECT max(item_id) AS k FROM items WHERE item_id <= (SELECT max(item_id) * 9 // 10 FROM items))
SELECT item_id, l_partkey AS product_id, l_extendedprice AS unit_price FROM items
WHERE item_id > (SELECT k FROM mark)""")
def w2(spark, sf):
    items = m.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("unit_price"))
    mark = items.agg(F.floor(F.max("item_id") * 9 / 10)).scalar()
    return W.incremental_new(items, items.filter(F.col("item_id") <= mark), "item_id")


@register("w2_incremental_orders", sql("order_headers", _PAIR + """
SELECT order_id, partner_id, order_status, CAST(taxful_total_price AS DOUBLE) AS price, order_date FROM source
WHERE order_id >= (SELECT max(order_id) FROM replica) AND order_id NOT IN (SELECT order_id FROM replica)"""))
def w2_orders(spark, sf):
    new = W.incremental_new(_source(spark, sf), _replica(spark, sf), "order_id", inclusive=True)
    return new.select("order_id", "partner_id", "order_status",
                      F.col("taxful_total_price").cast("double").alias("price"), "order_date")


@register("w3_apply_updates", sql("order_headers", _PAIR + """
SELECT r.order_id, coalesce(c.order_status, r.order_status) AS order_status FROM replica r
LEFT JOIN changes c ON r.order_id = c.order_id"""))
def w3(spark, sf):
    source = _source(spark, sf)
    changes = W.pending_updates(source, _since(source))
    return W.apply_updates(_replica(spark, sf), changes).select("order_id", "order_status")


@register("w3_next_watermark", sql("order_headers", _PAIR + "SELECT max(updated_at) AS watermark FROM changes"))
def w3_mark(spark, sf):
    source = _source(spark, sf)
    return W.next_watermark(W.pending_updates(source, _since(source)), _since(source)).select("watermark")


@register("w4_detect_deletes", sql("order_headers", _PAIR + """
SELECT order_id FROM replica WHERE order_id NOT IN (SELECT order_id FROM source)"""))
def w4(spark, sf):
    return W.detect_deletes(_replica(spark, sf), _source(spark, sf))


@register("w4_ranged_deletes", sql("order_headers", _PAIR + """
SELECT order_id FROM replica WHERE order_id NOT IN (SELECT order_id FROM source)"""))
def w4_ranged(spark, sf):
    """Both sides kept in key ranges with digest trees: only ranges that differ are read for the comparison."""
    folder = work_path(spark, "w4")
    ours, theirs = RangedTable(spark, f"{folder}/target", "order_id"), RangedTable(spark, f"{folder}/source", "order_id")
    ours.replace(_replica(spark, sf).select("order_id"), 0)
    theirs.replace(_source(spark, sf).select("order_id"), 0)
    ranges = ours.tree.differing(theirs.tree)
    return W.detect_deletes(ours.read(ranges), theirs.read(ranges))


@register("w5_cdc_pass", sql("order_headers", _PAIR + """
SELECT g.order_id, coalesce(c.order_status, g.order_status) AS order_status FROM grown g
LEFT JOIN changes c ON g.order_id = c.order_id WHERE g.order_id NOT IN (SELECT order_id FROM gone)"""))
def w5(spark, sf):
    source = _source(spark, sf)
    after, _ = W.cdc_pass(_replica(spark, sf), source, _since(source))
    return after.select("order_id", "order_status")


@register("w5_cdc_counts", sql("order_headers", _PAIR + """
SELECT 'new' AS step, count(*) AS rows FROM newer UNION ALL SELECT 'updated', count(*) FROM changes
UNION ALL SELECT 'deleted', count(*) FROM gone"""))
def w5_counts(spark, sf):
    source = _source(spark, sf)
    return W.cdc_pass(_replica(spark, sf), source, _since(source))[1]


@register("w6_upsert", sql("order_headers", """
SELECT order_id, partner_id, max(updated_at) AS version,
  CASE WHEN bool_or(updated_at > created_at) THEN 'shipped' ELSE any_value(order_status) END AS order_status
FROM order_headers GROUP BY 1, 2"""))
def w6(spark, sf):
    base = m.order_headers(spark, sf).select("order_id", "partner_id", F.col("created_at").alias("version"), "order_status")
    later = m.order_headers(spark, sf).filter("updated_at > created_at").select(
        "order_id", "partner_id", F.col("updated_at").alias("version"), F.lit("shipped").alias("order_status"))
    return W.upsert(base, later, ["order_id", "partner_id"], "version")


@register("w6_parted_upsert", sql("order_headers", """
SELECT order_id, partner_id, max(updated_at) AS version,
  CASE WHEN bool_or(updated_at > created_at) THEN 'shipped' ELSE any_value(order_status) END AS order_status
FROM order_headers GROUP BY 1, 2"""))
def w6_parted(spark, sf):
    """The base stored in parts by key hash, the changes upserted in two loads."""
    keys = ["order_id", "partner_id"]
    table, part = PartedTable(spark, work_path(spark, "w6")), W.key_part(keys, 32)
    headers = m.order_headers(spark, sf)
    base = headers.select(*keys, F.col("created_at").alias("version"), "order_status")
    later = headers.filter("updated_at > created_at").select(*keys, F.col("updated_at").alias("version"), F.lit("shipped").alias("order_status"))
    table.replace(base, part, 0)
    for number in (1, 2):
        W.upsert_parts(table, later.filter(F.col("partner_id") % 2 == number - 1), keys, "version", part, number)
    return table.read()


@register("w7_replication_lag", sql("order_headers", _PAIR + """
SELECT *, s - t AS lag, 'fast_forward' AS mode, 5000 AS batch_size, 100.0::DOUBLE * (1.0::DOUBLE - (s - t) / (s - t + n)) AS progress_pct
FROM (SELECT (SELECT max(order_id) FROM source) AS s, max(order_id) AS t, count(*) AS n FROM replica)""")
    .replace("SELECT *, s - t AS lag", "SELECT s AS source_max, t AS target_max, s - t AS lag"))
def w7(spark, sf):
    return W.replication_lag(_source(spark, sf), _replica(spark, sf))


@register("w8_ingest_clickstream", sql("clickstream_json", """
SELECT j->>'event_id' AS event_id, CAST(j->>'event_timestamp' AS TIMESTAMP) AS event_time, CAST(j->>'partner_id' AS INTEGER) AS partner_id,
  j->>'session_id' AS session_id, CAST(j->>'user_id' AS INTEGER) AS user_id, j->>'event_type' AS event_type, j->>'page_url' AS page_url,
  j->>'$.event_properties.product_name' AS product_name, j->>'$.event_properties.category' AS product_category,
  CASE WHEN json_type(j, '$.event_properties.price') = 'VARCHAR' THEN 0 ELSE CAST(j->>'$.event_properties.price' AS DECIMAL(10,2)) END AS product_price,
  '' AS referrer, coalesce(j->>'$.device_info.os', '') AS user_agent, j->>'$.device_info.type' AS device_type, '' AS country
FROM (SELECT CAST(value AS JSON) AS j FROM clickstream_json WHERE json_valid(value))""").replace("THEN 0 ELSE CAST(", "THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST("))
def w8(spark, sf):
    return W.ingest_clickstream(m.clickstream_json(spark, sf))


@register("w8_ingest_counters", sql("clickstream_json", """
SELECT count(*) AS consumed, count(*) FILTER (json_valid(value)) AS loaded, count(*) FILTER (NOT json_valid(value)) AS errors
FROM clickstream_json"""))
def w8_counters(spark, sf):
    return W.ingest_counters(m.clickstream_json(spark, sf))


@register("w10_load_chunks", sql("chunks", """
SELECT 'acme' AS tenant_id, 'manual' AS corpus_id, row_id, coalesce(nullif(content_type, 'table'), 'text') AS content_type, content,
  array_to_string(entity_names, '|') AS entity_names, '[]' AS entities,
  CASE WHEN len(entity_names) = 0 THEN '[]' ELSE '[{"source":"' || entity_names[1] || '"}]' END AS relationships,
  0 AS n_neighbors, doc_id, chunk_index, 0 AS page_number FROM chunks"""))
def w10(spark, sf):
    first = F.struct(F.element_at("entity_names", 1).alias("source"))
    dump = m.chunks(spark, sf).select(
        "row_id", F.nullif(F.col("content_type"), F.lit("table")).alias("content_type"), "content", "entity_names",
        F.when(F.size("entity_names") > 0, F.array(first)).alias("relationships"), "doc_id", "chunk_index")
    path = work_path(spark, "chunk-dump")
    dump.write.json(path)
    loaded = W.load_chunks(spark, path, "acme", "manual", json_array=False)
    return loaded.select("tenant_id", "corpus_id", "row_id", "content_type", "content",
                         F.array_join("entity_names", "|").alias("entity_names"), "entities", "relationships",
                         F.size("neighbor_ids").alias("n_neighbors"), "doc_id", "chunk_index", "page_number")


_LOADED = """
SELECT row_id, coalesce(nullif(content_type, 'table'), 'text') AS content_type, content, doc_id, chunk_index,
  CASE WHEN len(entity_names) = 0 THEN '[]' ELSE '[{"source":"' || entity_names[1] || '"}]' END AS relationships FROM chunks"""


@register("w10_load_arrays", sql("chunks", _LOADED))
def w10_arrays(spark, sf):
    """The array form, in files of bounded size; a second load leaves the loaded table as it is."""
    first = F.struct(F.element_at("entity_names", 1).alias("source"))
    dump = m.chunks(spark, sf).select(
        "row_id", F.nullif(F.col("content_type"), F.lit("table")).alias("content_type"), "content", "entity_names",
        F.when(F.size("entity_names") > 0, F.array(first)).alias("relationships"), "doc_id", "chunk_index")
    folder = work_path(spark, "chunk-arrays")
    W.write_chunk_arrays(dump, folder)
    loaded = cut_lineage(W.load_chunks(spark, folder, "acme", "manual"))
    again = W.load_chunks(spark, folder, "other", "manual", target=loaded)
    return again.filter("tenant_id = 'acme'").select("row_id", "content_type", "content", "doc_id", "chunk_index", "relationships")


_BATCHES = """, batches AS (SELECT TRY_CAST(regexp_extract(value, '"user_id":([0-9]+)', 1) AS BIGINT) // 64 AS batch, value FROM clickstream_json),
reports AS (SELECT batch, CASE WHEN batch % 5 = 4 THEN 'Publish Timeout' WHEN batch >= 7 THEN 'Fail' ELSE 'Success' END AS status,
  count(*) FILTER (json_valid(value)) AS loaded_rows, count(*) FILTER (NOT json_valid(value)) AS filtered_rows,
  CAST(sum(strlen(value)) AS BIGINT) AS load_bytes FROM batches WHERE batch IS NOT NULL GROUP BY 1),
stop AS (SELECT min(batch) AS failed_batch FROM reports WHERE status NOT IN ('Success', 'Publish Timeout'))
"""


@register("w11_load_outcome", sql("clickstream_json", _BATCHES + """
SELECT count(*) AS batches, CAST(coalesce(sum(loaded_rows), 0) AS BIGINT) AS loaded_rows, CAST(coalesce(sum(filtered_rows), 0) AS BIGINT) AS filtered_rows,
  CAST(coalesce(sum(load_bytes), 0) AS BIGINT) AS load_bytes, any_value(failed_batch) AS failed_batch
FROM reports, stop WHERE failed_batch IS NULL OR batch < failed_batch"""))
def w11_outcome(spark, sf):
    number = F.regexp_extract("value", '"user_id":([0-9]+)', 1).try_cast("long")
    rows = m.clickstream_json(spark, sf).withColumn("batch", F.floor(number / 64).cast("long")).filter("batch IS NOT NULL")
    report = W.load_report(rows, "batch", F.try_parse_json("value").isNotNull(), F.col("value")).filter("is_total = 0")
    status = F.when(F.col("batch") % 5 == 4, "Publish Timeout").when(F.col("batch") >= 7, "Fail").otherwise("Success")
    return W.load_outcome(report.withColumn("status", status))


@register("w11_load_report", sql("clickstream_json", """
SELECT event_type AS batch, count(*) AS total_rows, count(*) FILTER (json_valid(value)) AS loaded_rows,
  count(*) FILTER (NOT json_valid(value)) AS filtered_rows, CAST(sum(strlen(value)) AS BIGINT) AS load_bytes,
  CAST(grouping(event_type) AS INTEGER) AS is_total
FROM (SELECT value, regexp_extract(value, '"partner_id":([0-9]+)', 1) AS event_type FROM clickstream_json)
GROUP BY ROLLUP (event_type)"""))
def w11(spark, sf):
    rows = m.clickstream_json(spark, sf).withColumn("batch", F.regexp_extract("value", '"partner_id":([0-9]+)', 1))
    return W.load_report(rows, "batch", F.try_parse_json("value").isNotNull(), F.col("value"))


@register("w13_retention", sql("clickstream", """
SELECT CAST(event_time AS DATE) AS event_date,
  CAST(event_time AS DATE) BETWEEN CAST(now AS DATE) - 7 AND CAST(now AS DATE) + 3 AS accepted, count(*) AS rows
FROM clickstream, (SELECT max(event_time) AS now FROM clickstream) GROUP BY 1, 2"""))
def w13(spark, sf):
    checked = W.with_partition_check(m.clickstream(spark, sf), "event_time")
    return checked.groupBy("event_date", "accepted").agg(F.count("*").alias("rows"))


@register("w14_missing_days", """
WITH now AS (SELECT CAST(max(ts) AS DATE) AS d FROM events),
grid AS (SELECT t AS table_name, CAST(d - CAST(i AS INTEGER) AS DATE) AS day FROM now, range(1, 41) r(i), (VALUES ('errors'), ('events'), ('spans')) v(t)),
seen AS (SELECT 'events' AS table_name, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 2
  UNION ALL SELECT 'spans', CAST(ts AS DATE), count(*) FROM events GROUP BY 2
  UNION ALL SELECT 'errors', CAST(ts AS DATE), count(*) FROM events WHERE event_type = 'error' AND value > 489 GROUP BY 2)
SELECT table_name, 'p' || strftime(day, '%Y%m%d') AS partition_name, day AS from_day, CAST(day + 1 AS DATE) AS to_day,
  coalesce(n, 0) AS row_count, n IS NULL AS is_missing FROM grid LEFT JOIN seen USING (table_name, day)""")
def w14(spark, sf):
    events = m.table(spark, sf, "events")
    tables = {"events": (events, "ts"), "spans": (m.spans(spark, sf), "timestamp"),
              "errors": (events.filter("event_type = 'error' AND value > 489"), "ts")}
    return W.missing_days(tables, events.agg(F.max("ts")).scalar(), 40)


@register("w15_ttl_cleanup", sql("order_headers", """
SELECT 'orders' AS table_name, count(*) FILTER (order_date < now - INTERVAL 365 DAY) AS deleted_count
FROM order_headers, (SELECT max(order_date) AS now FROM order_headers)"""))
def w15(spark, sf):
    return W.ttl_cleanup(m.order_headers(spark, sf), "order_date", "orders", days=365)[1]


@register("w15_ttl_kept", sql("order_headers", """
SELECT order_id, order_date FROM order_headers WHERE order_date >= (SELECT max(order_date) FROM order_headers) - INTERVAL 365 DAY"""))
def w15_kept(spark, sf):
    return W.ttl_cleanup(m.order_headers(spark, sf), "order_date", "orders", days=365)[0].select("order_id", "order_date")


@register("w17_insert_attributes", sql("spans", """
SELECT span_id, 'deployment.environment=demo' || CASE WHEN k IS NOT NULL THEN ',k=' || k ELSE ',k=none' END AS attributes FROM spans"""))
def w17(spark, sf):
    filled = W.insert_attributes("span_attributes", {"deployment.environment": "demo", "k": "none"})
    shown = F.transform(F.array_sort(F.map_entries("a")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.spans(spark, sf).withColumn("a", filled).select("span_id", F.array_join(shown, ",").alias("attributes"))


@register("w18_local_literal", """
SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time,
  'p' || strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') AS partition_name FROM events""")
def w18(spark, sf):
    local = times.to_local_literal("ts", "Asia/Singapore")
    return m.table(spark, sf, "events").select(
        "event_id", local.alias("local_time"), times.partition_of(local).alias("partition_name"))


@register("w21_row_uid", """
SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || coalesce(k, 'null')
  || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}') AS uid
FROM (SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events)""")
def w21(spark, sf):
    k = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int"))
    rows = m.table(spark, sf, "events").select(
        "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), k.alias("k"))
    return rows.select("event_id", W.row_uid(rows).alias("uid"))
