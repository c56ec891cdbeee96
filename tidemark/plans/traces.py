"""Registered trace and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scale import exact_percentiles
from tidemark.operators import traces as T
from tidemark.plans.register import Registry
from tidemark.plans.views_sql import sql
from tidemark.sources import testmodel as m

register = Registry()

BOUNDS = [2, 10, 50, 100, 250, 400]

_FACTS = """min(timestamp) AS time, count(*) AS spans,
  count(*) FILTER (status_code = 'STATUS_CODE_ERROR') AS error_spans, max(duration) / 1000 AS max_span_duration_ms,
  (epoch_us(max(timestamp + to_microseconds(duration))) - epoch_us(min(timestamp))) / 1000 AS trace_duration_ms,
  coalesce(max(duration) FILTER (parent_span_id IS NULL), 0) / 1000 AS root_span_duration_ms,
  string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services"""


@register("t1_trace_list", sql("spans", """
SELECT trace_id, min(timestamp) AS time, max(duration) / 1000 AS duration_ms, count(*) AS spans,
  count(*) FILTER (status_code = 'STATUS_CODE_ERROR') AS errors, string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services
FROM spans WHERE trace_id IN (
  SELECT trace_id FROM spans WHERE service_name = 'svc-2' AND status_code = 'STATUS_CODE_ERROR'
  GROUP BY 1 ORDER BY min(timestamp) DESC, trace_id DESC LIMIT 100)
GROUP BY 1"""))
def t1(spark, sf):
    listed = T.trace_list(m.spans(spark, sf), service="svc-2", status=T.ERROR)
    return listed.withColumn("services", F.array_join("services", ","))


def _search_sql(hit, bounded, roots, order, limit, offset):
    return sql("spans", f"""
, d AS (SELECT trace_id, (epoch_us(max(end_time)) - epoch_us(min(timestamp))) / 1000 AS bounded FROM spans
        WHERE timestamp >= '2024-01-05' AND timestamp < '2024-01-25' GROUP BY 1),
ids AS (SELECT DISTINCT trace_id FROM spans JOIN d USING (trace_id)
        WHERE timestamp >= '2024-01-05' AND timestamp < '2024-01-25' AND {hit} AND {bounded}),
roots AS (SELECT trace_id, span_name AS operation, service_name AS root_service FROM spans WHERE parent_span_id IS NULL AND {roots}),
found AS (SELECT trace_id, operation, root_service, {_FACTS}
          FROM spans JOIN ids USING (trace_id) JOIN roots USING (trace_id) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, count(*) OVER () AS total_count,
  CAST(row_number() OVER (ORDER BY {order}, trace_id, operation, root_service) AS INTEGER) AS rn FROM found)
WHERE rn > {offset} AND rn <= {offset + limit}""")


@register("t2_trace_search", _search_sql(
    "service_name = 'svc-1'", "bounded BETWEEN 1000 AND 4000000", "service_name = 'svc-1'", "trace_duration_ms DESC", 100, 0))
def t2(spark, sf):
    page = T.trace_search(m.spans(spark, sf), service="svc-1", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00",
                          min_duration="1s", max_duration="4000s", sort="longest-duration", page_size=100)
    return page.withColumn("services", F.array_join("services", ","))


@register("t2_trace_search_page", _search_sql(
    "k = '7'", "true", "true", "time DESC", 20, 20))
def t2_page(spark, sf):
    page = T.trace_search(m.spans(spark, sf), tags="k=7", start="2024-01-05 00:00:00", end="2024-01-25 00:00:00",
                          page=2, page_size=20)
    return page.withColumn("services", F.array_join("services", ","))


@register("t3_trace_durations", sql("spans", """
SELECT trace_id, (epoch_us(max(end_time)) - epoch_us(min(timestamp))) / 1000 AS filter_duration_ms,
  (epoch_us(max(timestamp + to_microseconds(duration))) - epoch_us(min(timestamp))) / 1000 AS trace_duration_ms
FROM spans GROUP BY 1"""))
def t3(spark, sf):
    return T.trace_durations(m.spans(spark, sf))


@register("t3_trace_durations_seconds", sql("spans", """
SELECT trace_id, CAST((epoch_us(date_trunc('second', max(end_time))) - epoch_us(date_trunc('second', min(timestamp)))) // 1000 AS DOUBLE)
  AS filter_duration_ms FROM spans GROUP BY 1"""))
def t3_seconds(spark, sf):
    return T.trace_durations(m.spans(spark, sf), legacy_seconds=True).select("trace_id", "filter_duration_ms")


@register("t4_trace_facts", sql("spans", f"SELECT trace_id, {_FACTS} FROM spans GROUP BY 1"))
def t4(spark, sf):
    return T.trace_facts(m.spans(spark, sf)).withColumn("services", F.array_join("services", ","))


@register("t5_tag_filter", sql("spans", "SELECT trace_id, span_id FROM spans WHERE k = '12' AND host = 'host-1'"))
def t5(spark, sf):
    both = T.tag_filter("k=12") & T.tag_filter("host=host-1", "resource_attributes")
    return m.spans(spark, sf).filter(both).select("trace_id", "span_id")


@register("t7_trace_detail", sql("spans", """
SELECT trace_id AS "traceID", span_id AS "spanID", parent_span_id AS "parentSpanID", span_name AS "operationName",
  service_name AS "serviceName", '[{"key":"host","value":"' || host || '"}]' AS "serviceTags", epoch_us(timestamp) // 1000 AS "startTime",
  duration / 1000 AS duration, CASE WHEN k IS NULL THEN '[]' ELSE '[{"key":"k","value":"' || k || '"}]' END AS tags, span_kind AS kind,
  CASE status_code WHEN 'STATUS_CODE_OK' THEN 1 WHEN 'STATUS_CODE_ERROR' THEN 2 ELSE 0 END AS "statusCode" FROM spans"""))
def t7(spark, sf):
    return T.trace_detail(m.spans(spark, sf))


_POINTS = """, points AS (SELECT time_bucket(INTERVAL 10 MINUTE, timestamp) AS timestamp, service_name, span_name, count(*) AS count,
  sum(duration) / 1000 AS sum, """ + ", ".join(
    f"count(*) FILTER (duration > {lo} AND duration <= {hi}) AS b{i}"
    for i, (lo, hi) in enumerate(zip([-1] + [b * 1000 for b in BOUNDS], [b * 1000 for b in BOUNDS] + [10**15]))) + """
  FROM spans GROUP BY 1, 2, 3)
"""
_BUCKETS = " || ',' || ".join(f"b{i}" for i in range(len(BOUNDS) + 1))


def _points(spark, sf):
    return T.span_metrics(m.spans(spark, sf), BOUNDS, 10, "minute")


@register("t8_request_rate", sql("spans", _POINTS + """
SELECT service_name, time_bucket(INTERVAL 1 HOUR, timestamp) AS time, span_name, sum(count) / 3600 AS qps FROM points GROUP BY 1, 2, 3"""))
def t8(spark, sf):
    return T.request_rate(_points(spark, sf), 1, "hour")


@register("t9_mean_duration", sql("spans", """
SELECT service_name, date_trunc('hour', timestamp) AS time, span_name, round(sum(duration) / 1000 / count(*), 6) AS avg_duration
FROM spans GROUP BY 1, 2, 3"""))
def t9(spark, sf):
    mean = T.mean_duration(_points(spark, sf), 1, "hour")
    return mean.withColumn("avg_duration", F.round("avg_duration", 6))


@register("t10_span_metrics", sql("spans", _POINTS + f"""
SELECT timestamp, service_name, span_name, count, sum, {_BUCKETS} AS bucket_counts FROM points"""))
def t10(spark, sf):
    return _points(spark, sf).select(
        "timestamp", "service_name", F.col("attributes")["span.name"].alias("span_name"), "count", "sum",
        F.array_join(F.col("bucket_counts").cast("array<string>"), ",").alias("bucket_counts"))


@register("t11_service_graph", sql("spans", """
SELECT p.service_name AS parent_service, c.service_name AS child_service, count(*) AS calls,
  count(*) FILTER (c.status_code = 'STATUS_CODE_ERROR') AS errors
FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
WHERE c.service_name <> p.service_name GROUP BY 1, 2"""))
def t11(spark, sf):
    return T.service_graph(m.spans(spark, sf))


def _values(spark, sf):
    """Raw metric points: one value per event."""
    return m.spans(spark, sf).select(
        "service_name", F.col("span_name").alias("metric_name"), "timestamp",
        F.col("span_id").cast("long").alias("point_id"), F.col("duration").alias("value"))


@register("t12_rollup_sum", sql("spans", """
SELECT service_name, span_name AS metric_name, date_trunc('day', timestamp) AS time, CAST(sum(duration) AS BIGINT) AS value,
  count(*) AS points FROM spans GROUP BY 1, 2, 3"""))
def t12_sum(spark, sf):
    return T.metric_rollup(_values(spark, sf), "sum", 1, "day")


@register("t12_rollup_gauge", sql("spans", """
SELECT service_name, span_name AS metric_name, date_trunc('day', timestamp) AS time,
  arg_max(duration, (timestamp, CAST(span_id AS BIGINT))) AS last, CAST(sum(duration) AS BIGINT) / count(*) AS mean, count(*) AS points
FROM spans GROUP BY 1, 2, 3"""))
def t12_gauge(spark, sf):
    return T.metric_rollup(_values(spark, sf), "gauge", 1, "day")


@register("t12_rollup_histogram", sql("spans", _POINTS + "SELECT service_name, 'traces.span.metrics.duration' AS metric_name, "
  "date_trunc('day', timestamp) AS time, CAST(sum(count) AS BIGINT) AS count, round(sum(sum), 3) AS sum, "
  + " || ',' || ".join(f"CAST(sum(b{i}) AS BIGINT)" for i in range(len(BOUNDS) + 1)) + " AS bucket_counts FROM points GROUP BY 1, 2, 3"))
def t12_histogram(spark, sf):
    rolled = T.metric_rollup(_points(spark, sf), "histogram", 1, "day", n_buckets=len(BOUNDS) + 1)
    return rolled.withColumn("sum", F.round("sum", 3)).withColumn(
        "bucket_counts", F.array_join(F.col("bucket_counts").cast("array<string>"), ","))


@register("t12_rollup_summary", sql("spans", """
, q AS (SELECT service_name, date_trunc('hour', timestamp) AS h, count(*) AS count, CAST(sum(duration) AS BIGINT) AS sum,
    quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.99) AS p99 FROM spans GROUP BY 1, 2)
SELECT service_name, date_trunc('day', h) AS time, CAST(sum(count) AS BIGINT) AS count, CAST(sum(sum) AS BIGINT) AS sum,
  arg_max(p50, h) AS p50, arg_max(p99, h) AS p99 FROM q GROUP BY 1, 2"""))
def t12_summary(spark, sf):
    hourly = m.spans(spark, sf).withColumn("timestamp", T.times.floor_time("timestamp", 1, "hour"))
    keys = ["service_name", "timestamp"]
    quantiles = (exact_percentiles(hourly, keys, "duration", [0.5, 0.99], interpolate=False)
                 .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("prob", "value"))).alias("quantiles")))
    points = hourly.groupBy(*keys).agg(F.count("*").alias("count"), F.sum("duration").alias("sum")).join(quantiles, keys)
    rolled = T.metric_rollup(points, "summary", 1, "day", keys=["service_name"])
    return rolled.select("service_name", "time", "count", "sum", F.col("quantiles")[0.5].alias("p50"),
                         F.col("quantiles")[0.99].alias("p99"))
