"""Registered streaming jobs (run to the end of the available input) and latency reports.

Each job reads the event or document file as a stream; its result must equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import latency as S
from tidemark.operators.digests import RangedTable
from tidemark.plans.corpus import _MENTIONS, _NEAR
from tidemark.plans.ingest import _PAIR, _replica, _since, _source
from tidemark.plans.register import Registry
from tidemark.plans.traces import BOUNDS, _BUCKETS, _POINTS
from tidemark.plans.views_sql import sql
from tidemark.session import cut_lineage, work_path
from tidemark.sources import files, testmodel as m
from tidemark.sources.readers import parquet_stream
from tidemark.streaming import jobs

register = Registry()


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: a stream watches a folder, so a file is picked from its own."""
    path, schema = f"{sf}/{name}.parquet", m.table(spark, sf, name).schema
    return parquet_stream(spark, path, schema) if files.is_folder(spark, path) else parquet_stream(spark, sf, schema, f"{name}.parquet")


def _clicks(spark, sf):
    clicks = m.clickstream_from_events(_stream(spark, sf, "events"))
    return clicks.withColumn("event_time", F.col("event_time").cast("timestamp"))


@register("s1_stream_ingest", sql("clickstream_json", """
SELECT j->>'event_id' AS event_id, CAST(j->>'event_timestamp' AS TIMESTAMP) AS event_time, CAST(j->>'partner_id' AS INTEGER) AS partner_id,
  j->>'event_type' AS event_type, CASE WHEN json_type(j, '$.event_properties.price') = 'VARCHAR' THEN CAST(0 AS DECIMAL(10,2))
  ELSE CAST(j->>'$.event_properties.price' AS DECIMAL(10,2)) END AS product_price
FROM (SELECT CAST(value AS JSON) AS j FROM clickstream_json WHERE json_valid(value))"""))
def s1(spark, sf):
    folder = work_path(spark, "s1")
    jobs.ingest_clickstream(m.clickstream_json_from_events(_stream(spark, sf, "events")), folder).awaitTermination()
    facts = jobs.facts(spark, folder)
    return facts.select("event_id", "event_time", "partner_id", "event_type", "product_price")


@register("s1_ingest_counters", sql("clickstream_json", """
SELECT count(*) AS consumed, count(*) FILTER (json_valid(value)) AS loaded, count(*) FILTER (NOT json_valid(value)) AS errors,
  count(*) FILTER (NOT json_valid(value)) AS rejects FROM clickstream_json"""))
def s1_counters(spark, sf):
    folder = work_path(spark, "s1c")
    jobs.ingest_clickstream(m.clickstream_json_from_events(_stream(spark, sf, "events")), folder).awaitTermination()
    refused = jobs.rejects(spark, folder).agg(F.count("*")).scalar()
    return jobs.counters(spark, folder).agg(*[F.sum(c).alias(c) for c in ("consumed", "loaded", "errors")]).withColumn("rejects", refused)


@register("s2_stream_minutes", sql("clickstream", """
SELECT partner_id, date_trunc('minute', event_time) AS minute_start, count(*) AS count, CAST(sum(product_price) AS DOUBLE) AS revenue
FROM clickstream GROUP BY 1, 2"""))
def s2(spark, sf):
    folder = work_path(spark, "s2")
    keys = ["partner_id", "minute_start"]
    jobs.keep_updated(jobs.minute_counts(_clicks(spark, sf)), folder, keys).awaitTermination()
    return jobs.current(spark, folder, keys).withColumn("revenue", F.col("revenue").cast("double"))


@register("s3_stream_funnel", sql("clickstream", """
SELECT partner_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'cart') AS carts,
  count(*) FILTER (event_type = 'purchase') AS purchases
FROM clickstream WHERE event_time >= (SELECT max(event_time) FROM clickstream) - INTERVAL 7 DAY GROUP BY 1"""))
def s3(spark, sf):
    folder = work_path(spark, "s3")
    jobs.refresh_funnel(_clicks(spark, sf), folder, every=None).awaitTermination()
    return jobs.funnel_view(spark, folder)


@register("s4_stream_entities", sql("chunks", _MENTIONS + """
SELECT tenant_id, corpus_id, entity_name, count(*) AS freq, string_agg(DISTINCT row_id, '|' ORDER BY row_id) AS chunk_ids
FROM named GROUP BY 1, 2, 3 HAVING count(*) < 500"""))
def s4(spark, sf):
    folder = work_path(spark, "s4")
    jobs.refresh_indexes(m.chunks_from_documents(_stream(spark, sf, "documents")), folder).awaitTermination()
    return jobs.index_views(spark, folder)["entities"].withColumn("chunk_ids", F.array_join("chunk_ids", "|"))


@register("s4_stream_neighbors", sql("chunks", _NEAR + """
SELECT tenant_id, corpus_id, src_chunk, string_agg(neighbor, '|' ORDER BY neighbor) AS neighbor_chunks FROM near GROUP BY 1, 2, 3"""))
def s4_neighbors(spark, sf):
    folder = work_path(spark, "s4n")
    jobs.refresh_indexes(m.chunks_from_documents(_stream(spark, sf, "documents")), folder).awaitTermination()
    return jobs.index_views(spark, folder)["neighbors"].withColumn("neighbor_chunks", F.array_join("neighbor_chunks", "|"))


@register("s5_stream_span_metrics", sql("spans", _POINTS + f"""
SELECT timestamp, service_name, span_name, count, sum, {_BUCKETS} AS bucket_counts FROM points"""))
def s5(spark, sf):
    folder = work_path(spark, "s5")
    spans = m.spans_from_events(_stream(spark, sf, "events")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    points = jobs.span_metrics(spans, BOUNDS, 10, "minute").select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "service_name",
        F.col("attributes")["span.name"].alias("span_name"), "count", "sum", "bucket_counts")
    keys = ["timestamp", "service_name", "span_name"]
    jobs.keep_updated(points, folder, keys).awaitTermination()
    now = jobs.current(spark, folder, keys)
    return now.withColumn("bucket_counts", F.array_join(F.col("bucket_counts").cast("array<string>"), ","))


@register("s6_cdc_loop", sql("order_headers", _PAIR + """
SELECT g.order_id, coalesce(c.order_status, g.order_status) AS order_status FROM grown g
LEFT JOIN changes c ON g.order_id = c.order_id WHERE g.order_id NOT IN (SELECT order_id FROM gone)"""))
def s6(spark, sf):
    folder = work_path(spark, "s6")
    source, base = cut_lineage(_source(spark, sf)), _replica(spark, sf)
    ticks = _stream(spark, sf, "orders").select("o_orderkey")
    jobs.cdc_loop(ticks, lambda: source, base, folder, _since(source), every=None).awaitTermination()
    return jobs.cdc_view(spark, folder, base).select("order_id", "order_status")


@register("s6_cdc_ranges", sql("order_headers", _PAIR + """
SELECT g.order_id, coalesce(c.order_status, g.order_status) AS order_status FROM grown g
LEFT JOIN changes c ON g.order_id = c.order_id WHERE g.order_id NOT IN (SELECT order_id FROM gone)"""))
def s6_ranges(spark, sf):
    """The source moves between ticks: first nothing was updated yet, then states change, then orders come and go."""
    folder = work_path(spark, "s6r")
    source, base = cut_lineage(_source(spark, sf)), _replica(spark, sf)
    moved, copy = RangedTable(spark, f"{folder}/source", "order_id"), RangedTable(spark, f"{folder}/target", "order_id")
    copy.replace(base, 0)
    changed = base.join(source.select("order_id", F.col("order_status").alias("_now")), "order_id", "left").withColumn(
        "order_status", F.coalesce("_now", "order_status")).drop("_now")
    ticks = f"{folder}/ticks"
    for tick, state in enumerate((base.withColumn("updated_at", F.col("created_at")), changed, source)):
        moved.replace(state.select(*base.columns), tick)
        spark.range(tick, tick + 1).write.mode("append").parquet(ticks)
        jobs.cdc_ranges(parquet_stream(spark, ticks, spark.range(1).schema), moved, copy, folder, _since(source), every=None).awaitTermination()
    return copy.read().select("order_id", "order_status")


@register("s7_late_rows", """
SELECT CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-18' THEN 'accepted' ELSE 'rejected' END AS state,
  CAST(ts AS DATE) AS event_date, count(*) AS rows FROM events GROUP BY 1, 2""")
def s7(spark, sf):
    folder = work_path(spark, "s7")
    jobs.split_by_partition(_clicks(spark, sf), folder, "2024-01-15 00:00:00").awaitTermination()
    return jobs.split_counts(spark, folder)


@register("s8_latency_percentiles", sql("bench_events", """
SELECT event_type, round(quantile_cont(lat, 0.5), 6) AS p50, round(quantile_cont(lat, 0.9), 6) AS p90, round(quantile_cont(lat, 0.95), 6) AS p95,
  round(quantile_cont(lat, 0.99), 6) AS p99, round(quantile_cont(lat, 0.999), 6) AS p999, min(lat) AS min_ms
FROM (SELECT event_type, event_id % 1000 + 200 AS lat FROM bench_events) GROUP BY 1"""))
def s8(spark, sf):
    found = S.latency_percentiles(m.bench_events(spark, sf), ["event_type"])
    return found.withColumns({p: F.round(p, 6) for p in ("p50", "p90", "p95", "p99", "p999")})


@register("s8_live_percentiles", sql("bench_events", """
SELECT event_type, count(*) AS events, min(event_id % 1000 + 200) AS min_ms, true AS within_bound FROM bench_events GROUP BY 1"""))
def s8_live(spark, sf):
    """Sketches of a stream, folded; each percentile's true rank must lie within 1 % of the asked one."""
    folder = work_path(spark, "s8")
    jobs.keep_percentiles(m.bench_events_from_events(_stream(spark, sf, "events")), folder, ["event_type"]).awaitTermination()
    live = jobs.live_percentiles(spark, folder, ["event_type"])
    rows = S.event_latency(m.bench_events(spark, sf)).groupBy("event_type", "lat_ms").agg(F.count("*").alias("n"))
    asked = live.select("event_type", "events", "min_ms", F.posexplode("percentiles").alias("place", "value"))
    ranked = rows.join(asked, "event_type").groupBy("event_type", "events", "min_ms", "place").agg(
        F.sum(F.when(F.col("lat_ms") < F.col("value"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("lat_ms") <= F.col("value"), F.col("n")).otherwise(0)).alias("upto"))
    share = F.element_at(F.array(*[F.lit(p) for p in S.PROBS]), F.col("place") + 1) * F.col("events")
    near = (F.col("below") <= share + 0.01 * F.col("events")) & (F.col("upto") >= share - 0.01 * F.col("events"))
    return ranked.groupBy("event_type", "events", "min_ms").agg(F.bool_and(near).alias("within_bound"))


@register("s9_steady_state", """
SELECT count(*) AS landed, count(*) AS produced, true AS is_steady FROM events""")
def s9(spark, sf):
    return S.steady_state(m.table(spark, sf, "events"), m.bench_events(spark, sf))


@register("s10_throughput", sql("bench_events", """
SELECT messages, bytes, seconds, messages / seconds AS messages_per_s, bytes / 1048576.0::DOUBLE / seconds AS mb_per_s FROM (
  SELECT count(*) AS messages, CAST(sum(payload_bytes) AS BIGINT) AS bytes, (epoch_us(max(ingest_time)) - epoch_us(min(ingest_time))) / 1e6 AS seconds
  FROM bench_events WHERE ingest_time >= (SELECT min(ingest_time) FROM bench_events) + INTERVAL 86400 SECOND)"""))
def s10(spark, sf):
    return S.throughput(m.bench_events(spark, sf), "ingest_time", "payload_bytes", 86400)


@register("s11_distinct_events", sql("clickstream", "SELECT event_id, partner_id, event_type FROM clickstream"))
def s11(spark, sf):
    clicks = m.clickstream(spark, sf).select("event_id", "partner_id", "event_type")
    return S.distinct_events(clicks.unionByName(clicks.filter("event_type = 'purchase'")))


@register("s11_stream_distinct", sql("clickstream", "SELECT event_id, partner_id, event_type FROM clickstream"))
def s11_stream(spark, sf):
    folder = work_path(spark, "s11")
    clicks = _clicks(spark, sf)
    twice = clicks.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("event_type") == "purchase", 2).otherwise(1))))
    jobs.store(jobs.distinct_events(twice), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("event_id", "partner_id", "event_type")
