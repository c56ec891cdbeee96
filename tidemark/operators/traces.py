"""Trace search, span metrics, service graph and metric roll-ups.

Spans carry ``trace_id, span_id, parent_span_id, span_name, service_name,
timestamp, end_time, duration`` (microseconds), ``status_code`` and attribute maps.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import times
from tidemark.functions.fixed_values import SPAN_DURATION_METRIC
from tidemark.session import cut_lineage

ERROR, OK = "STATUS_CODE_ERROR", "STATUS_CODE_OK"
_MS = {"ms": 1.0, "us": 0.001, "s": 1000.0}


def is_root() -> Column:
    return F.col("parent_span_id").isNull() | (F.col("parent_span_id") == "")


def parse_duration(text: str | None) -> float:
    """``250us``, ``1.5ms``, ``2s`` in milliseconds; anything else is 0."""
    found = re.fullmatch(r"\s*([0-9.]+)\s*(ms|us|s)\s*", text or "")
    return float(found[1]) * _MS[found[2]] if found else 0.0


def tag_filter(tags: str | None, column: str = "span_attributes") -> Column:
    """``k=v k2=v2`` as an AND of attribute equalities."""
    pairs = re.findall(r"(\w+)=([^\s]+)", tags or "")
    return reduce(Column.__and__, [F.col(column)[k] == v for k, v in pairs], F.lit(True))


def span_filter(service: str | None = None, operation: str | None = None, status: str | None = None,
                tags: str | None = None) -> Column:
    """All conditions have to hold on one and the same span; ``all`` means no filter."""
    wanted = [("service_name", service), ("span_name", operation), ("status_code", status)]
    tests = [F.col(c) == v for c, v in wanted if v and v != "all"]
    return reduce(Column.__and__, tests, tag_filter(tags))


def within(start=None, end=None, ts: str = "timestamp") -> Column:
    """Half-open time range."""
    tests = F.lit(True)
    if start is not None:
        tests = tests & (F.col(ts) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        tests = tests & (F.col(ts) < F.lit(str(end)).cast("timestamp_ntz"))
    return tests


def trace_list(spans: DataFrame, service: str | None = None, operation: str | None = None,
               status: str | None = None, start=None, end=None, limit: int = 100) -> DataFrame:
    """The newest traces with a matching span, described by all of their spans."""
    hits = spans.filter(within(start, end) & span_filter(service, operation, status))
    picked = (hits.groupBy("trace_id").agg(F.min("timestamp").alias("_first"))
              .orderBy(F.desc("_first"), F.desc("trace_id")).limit(limit).select("trace_id"))
    return (spans.join(picked, "trace_id", "left_semi").groupBy("trace_id").agg(
        F.min("timestamp").alias("time"), (F.max("duration") / 1000).alias("duration_ms"),
        F.count("*").alias("spans"), F.count_if(F.col("status_code") == ERROR).alias("errors"),
        F.array_sort(F.collect_set("service_name")).alias("services"))
        .orderBy(F.desc("time"), "trace_id"))


def trace_durations(spans: DataFrame, legacy_seconds: bool = False) -> DataFrame:
    """Both definitions per trace: by end time (for filtering) and by start + duration (for display)."""
    end = F.max("end_time")
    start = F.min("timestamp")
    if legacy_seconds:
        filter_ms = F.timestamp_diff("SECOND", F.date_trunc("second", start), F.date_trunc("second", end)) * 1000
    else:
        filter_ms = F.timestamp_diff("MICROSECOND", start, end) / 1000
    shown_end = F.max(F.timestamp_add("MICROSECOND", F.col("duration"), F.col("timestamp")))
    return spans.groupBy("trace_id").agg(
        filter_ms.cast("double").alias("filter_duration_ms"),
        (F.timestamp_diff("MICROSECOND", start, shown_end) / 1000).alias("trace_duration_ms"))


def _trace_facts() -> list[Column]:
    """What is shown per trace; over all spans, also those outside the time range."""
    start = F.min("timestamp")
    shown_end = F.max(F.timestamp_add("MICROSECOND", F.col("duration"), F.col("timestamp")))
    return [
        start.alias("time"), F.array_sort(F.collect_set("service_name")).alias("services"),
        F.count("*").alias("spans"), F.count_if(F.col("status_code") == ERROR).alias("error_spans"),
        (F.max("duration") / 1000).alias("max_span_duration_ms"),
        (F.timestamp_diff("MICROSECOND", start, shown_end) / 1000).alias("trace_duration_ms"),
        (F.max(F.when(is_root(), F.col("duration")).otherwise(0)) / 1000).alias("root_span_duration_ms")]


def trace_facts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(*_trace_facts())


_SORTS = {
    "most-recent": [F.desc, "time"], "longest-duration": [F.desc, "trace_duration_ms"],
    "shortest-duration": [F.asc, "trace_duration_ms"], "most-spans": [F.desc, "spans"],
    "least-spans": [F.asc, "spans"],
}


def trace_search(spans: DataFrame, service: str | None = None, operation: str | None = None,
                 status: str | None = None, tags: str | None = None, start=None, end=None,
                 min_duration: str | None = None, max_duration: str | None = None,
                 sort: str = "most-recent", page: int = 1, page_size: int = 1000) -> DataFrame:
    """A page of traces that match, with the total number of matches on each row.

    The spans that match choose the traces, whose facts are then aggregated.
    Root spans are joined afterwards: traces without a matching root drop out,
    and equal roots multiply the span counts.
    """
    in_time = within(start, end)
    hit = in_time & span_filter(service, operation, status, tags)
    bounded = F.timestamp_diff("MICROSECOND", F.min(F.when(in_time, F.col("timestamp"))),
                               F.max(F.when(in_time, F.col("end_time")))) / 1000
    # Matching spans first: only their traces are shuffled in full width.
    chosen = spans.filter(hit).select("trace_id").distinct()
    per_trace = spans.join(chosen, "trace_id", "left_semi").groupBy("trace_id").agg(
        bounded.alias("_bounded"), *_trace_facts())
    low, high = parse_duration(min_duration), parse_duration(max_duration)
    if low > 0:
        per_trace = per_trace.filter(F.col("_bounded") >= low)
    if high > 0:
        per_trace = per_trace.filter(F.col("_bounded") <= high)
    roots = (spans.filter(is_root() & span_filter(service, operation)).join(chosen, "trace_id", "left_semi")
             .groupBy("trace_id", F.col("span_name").alias("operation"), F.col("service_name").alias("root_service"))
             .agg(F.count("*").alias("_copies")))
    # One narrow row per trace and root, stored once for the page and the total.
    found = cut_lineage(per_trace.join(roots, "trace_id")
                        .withColumn("spans", F.col("spans") * F.col("_copies"))
                        .withColumn("error_spans", F.col("error_spans") * F.col("_copies"))
                        .drop("_bounded", "_copies"))
    way, column = _SORTS[sort]
    order = [way(column), F.asc("trace_id"), F.asc("operation"), F.asc("root_service")]
    shown = found.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    total = found.agg(F.count("*")).scalar()
    # Numbering touches only the rows of the page.
    number = F.row_number().over(Window.orderBy(*order)) + (page - 1) * page_size
    return shown.withColumn("rn", number).withColumn("total_count", total).orderBy("rn")


def _key_value_json(attributes: str) -> Column:
    pairs = F.transform(F.map_entries(F.col(attributes)),
                        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.to_json(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")))


def trace_detail(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Spans in the shape of the trace viewer, of one trace or of all."""
    rows = spans if trace_id is None else spans.filter(F.col("trace_id") == trace_id)
    return rows.select(
        F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"),
        F.col("parent_span_id").alias("parentSpanID"), F.col("span_name").alias("operationName"),
        F.col("service_name").alias("serviceName"), _key_value_json("resource_attributes").alias("serviceTags"),
        times.epoch_millis("timestamp").alias("startTime"), (F.col("duration") / 1000).alias("duration"),
        _key_value_json("span_attributes").alias("tags"), F.col("span_kind").alias("kind"),
        F.when(F.col("status_code") == OK, 1).when(F.col("status_code") == ERROR, 2).otherwise(0).alias("statusCode"))


def span_metrics(spans: DataFrame, bounds_ms: Sequence[float], n: int = 1, unit: str = "minute",
                 ts: str = "timestamp") -> DataFrame:
    """Duration histogram points per bucket, service and span name.

    ``bucket_counts[i]`` counts durations in (bounds[i-1], bounds[i]]; the last entry is the overflow.
    """
    ms = F.col("duration") / 1000
    edges = [None, *bounds_ms, None]
    counts = []
    for low, high in zip(edges, edges[1:]):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (ms > low)
        if high is not None:
            inside = inside & (ms <= high)
        counts.append(F.count_if(inside))
    points = spans.groupBy(F.window(ts, f"{n} {unit}").alias("_w"), "service_name", "span_name").agg(
        F.count("*").alias("count"), F.sum("duration").alias("_sum_us"), F.array(*counts).alias("bucket_counts"))
    return points.select(
        F.col("_w.start").alias("timestamp"), "service_name", F.lit(SPAN_DURATION_METRIC).alias("metric_name"),
        F.create_map(F.lit("span.name"), F.col("span_name")).alias("attributes"),
        "count", (F.col("_sum_us") / 1000).alias("sum"), "bucket_counts")


def _per_span_name(points: DataFrame, service: str | None, n: int, unit: str):
    rows = points.filter(F.col("metric_name") == SPAN_DURATION_METRIC)
    if service:
        rows = rows.filter(F.col("service_name") == service)
    return rows.groupBy("service_name", times.floor_time("timestamp", n, unit).alias("time"),
                        F.col("attributes")["span.name"].alias("span_name"))


def request_rate(points: DataFrame, n: int = 1, unit: str = "minute", service: str | None = None) -> DataFrame:
    """Requests per second for each span name and bucket."""
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * n
    return _per_span_name(points, service, n, unit).agg((F.sum("count") / F.lit(seconds)).alias("qps"))


def mean_duration(points: DataFrame, n: int = 1, unit: str = "minute", service: str | None = None) -> DataFrame:
    """Ratio of sums, so that busy points weigh more."""
    return _per_span_name(points, service, n, unit).agg((F.sum("sum") / F.sum("count")).alias("avg_duration"))


def service_graph(spans: DataFrame) -> DataFrame:
    """Calls between services: child spans counted per parent span first, then joined.

    The first count keeps the join small even when one parent has very many children.
    """
    calls = (spans.filter(~is_root()).groupBy("trace_id", "parent_span_id", F.col("service_name").alias("child_service"))
             .agg(F.count("*").alias("_calls"), F.count_if(F.col("status_code") == ERROR).alias("_errors")))
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"),
                           F.col("service_name").alias("parent_service"))
    return (calls.join(parents, ["trace_id", "parent_span_id"])
            .filter("parent_service <> child_service")
            .groupBy("parent_service", "child_service")
            .agg(F.sum("_calls").alias("calls"), F.sum("_errors").alias("errors")))


def metric_rollup(points: DataFrame, kind: str, n: int = 1, unit: str = "hour",
                  keys: Sequence[str] = ("service_name", "metric_name"), n_buckets: int | None = None) -> DataFrame:
    """Points of one metric kind rolled up to wider buckets.

    ``sum`` adds deltas; ``gauge`` keeps the last value and the mean; ``histogram``
    adds counts, sums and buckets element by element; ``summary`` adds counts and
    sums and keeps the last reported quantiles.
    """
    groups = points.groupBy(*keys, times.floor_time("timestamp", n, unit).alias("time"))
    latest = F.struct("timestamp", "point_id") if "point_id" in points.columns else F.col("timestamp")
    if kind == "sum":
        return groups.agg(F.sum("value").alias("value"), F.count("*").alias("points"))
    if kind == "gauge":
        return groups.agg(F.max_by("value", latest).alias("last"), F.avg("value").alias("mean"), F.count("*").alias("points"))
    if kind == "histogram":
        if n_buckets is None:
            raise ValueError("a histogram roll-up needs n_buckets")
        added = F.array(*[F.sum(F.col("bucket_counts")[i]) for i in range(n_buckets)])
        return groups.agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), added.alias("bucket_counts"))
    if kind == "summary":
        return groups.agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"),
                          F.max_by("quantiles", latest).alias("quantiles"))
    raise ValueError(f"unknown metric kind: {kind}")
