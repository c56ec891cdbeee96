"""Event-to-queryable latency, completeness and throughput of an ingest run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import times
from tidemark.functions.scale import exact_percentiles

PROBS = (0.5, 0.9, 0.95, 0.99, 0.999)


def event_latency(events: DataFrame, created: str = "event_timestamp", loaded: str = "ingest_time") -> DataFrame:
    """Milliseconds from the creation text (ISO, with ``T``) to the load time."""
    text = F.substring(F.replace(F.col(created), F.lit("T"), F.lit(" ")), 1, 23)
    stamp = F.try_to_timestamp(text).cast("timestamp_ntz")
    return events.withColumn("lat_ms", times.millis_between(stamp, loaded))


def latency_percentiles(events: DataFrame, keys: Sequence[str] = (), probs: Sequence[float] = PROBS) -> DataFrame:
    """Exact percentiles and the minimum, one column each."""
    timed = event_latency(events)
    rows = exact_percentiles(timed, keys, "lat_ms", probs)

    def named(p: float) -> str:
        return "p" + f"{p * 100:g}".replace(".", "")
    picked = rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(named(p)) for p in probs])
    least = timed.groupBy(*keys).agg(F.min("lat_ms").alias("min_ms"))
    if keys:
        return picked.join(least, list(keys))
    return picked.withColumn("min_ms", least.select("min_ms").scalar())


def latency_percentiles_approx(events: DataFrame, keys: Sequence[str] = (), probs: Sequence[float] = PROBS,
                               accuracy: int = 10000) -> DataFrame:
    """One-pass sketch version for dashboards."""
    timed = event_latency(events)
    return timed.groupBy(*keys).agg(
        F.percentile_approx("lat_ms", [float(p) for p in probs], accuracy).alias("percentiles"), F.min("lat_ms").alias("min_ms"))


def steady_state(produced: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows produced, rows landed, and whether nothing is missing."""
    counts = landed.agg(F.count("*").alias("landed")).withColumn("produced", produced.agg(F.count("*")).scalar())
    return counts.withColumn("is_steady", F.col("landed") == F.col("produced"))


def throughput(events: DataFrame, ts: str, payload_bytes: str, warmup_seconds: int = 0) -> DataFrame:
    """Messages and MiB per second after the warm-up."""
    start = events.agg(F.min(ts)).scalar() + F.expr(f"INTERVAL {int(warmup_seconds)} SECOND")
    measured = events.filter(F.col(ts) >= start).agg(
        F.count("*").alias("messages"), F.sum(payload_bytes).alias("bytes"),
        (F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 1e6).alias("seconds"))
    seconds = F.nullif(F.col("seconds"), F.lit(0.0))
    return measured.select("messages", "bytes", "seconds", (F.col("messages") / seconds).alias("messages_per_s"),
                           (F.col("bytes") / (1024.0 * 1024.0) / seconds).alias("mb_per_s"))


def distinct_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event id."""
    return events.dropDuplicates([key])
