"""Log search: filters, pages, histograms, context rows, value statistics.

Logs carry ``timestamp, service_name, severity_text, trace_id, body``. A filter
parameter of ``None`` or ``''`` means "do not filter".
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import text, times
from tidemark.functions.fixed_values import INTERVAL_LADDER

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def path(name: str, json_column: bool = True) -> Column:
    """``a.b.c`` as the value at b.c inside column a (JSON text or map/struct)."""
    head, *rest = name.split(".")
    if not rest:
        return F.col(head)
    if json_column:
        return F.get_json_object(head, "$" + "".join(f"['{p}']" for p in rest))
    value = F.col(head)
    for p in rest:
        value = value[p]
    return value


def condition(column: Column | str, op: str, values: Sequence = ()) -> Column:
    """One filter operator applied to a column (a name may be a dotted path)."""
    c = path(column) if isinstance(column, str) else column
    op = op.lower()
    if op in text.MATCHERS:
        return text.MATCHERS[op](c, values[0])
    simple = {
        "=": lambda: c == values[0],
        "!=": lambda: c != values[0],
        "in": lambda: c.isin(*values),
        "not in": lambda: ~c.isin(*values),
        "is null": lambda: c.isNull(),
        "is not null": lambda: c.isNotNull(),
        "like": lambda: c.like(values[0]),
        "not like": lambda: ~c.like(values[0]),
        "between": lambda: c.between(values[0], values[1]),
        "not between": lambda: ~c.between(values[0], values[1]),
    }
    if op not in simple:
        raise ValueError(f"unknown filter operator: {op}")
    return simple[op]()


def apply_filters(df: DataFrame, filters: Sequence[tuple]) -> DataFrame:
    """``[(column, operator, values)]`` joined by AND."""
    for column, op, *values in filters:
        df = df.filter(condition(column, op, values[0] if values else ()))
    return df


def in_range(df: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Rows between two instants, both inclusive."""
    if start is not None:
        df = df.filter(F.col(ts) >= (start if isinstance(start, Column) else F.lit(str(start)).cast("timestamp_ntz")))
    if end is not None:
        df = df.filter(F.col(ts) <= (end if isinstance(end, Column) else F.lit(str(end)).cast("timestamp_ntz")))
    return df


def select_logs(logs: DataFrame, service: str | None = None, level: str | None = None, match: str | None = None,
                how: str = "match_any", trace_id: str | None = None, start=None, end=None) -> DataFrame:
    """The shared filter of histogram and search; the cheap equalities come first."""
    logs = in_range(logs, start, end)
    for column, wanted in (("service_name", service), ("severity_text", level), ("trace_id", trace_id)):
        if wanted:
            logs = logs.filter(F.col(column) == wanted)
    return logs.filter(text.MATCHERS[how]("body", match)) if match else logs


def log_histogram(logs: DataFrame, n: int = 1, unit: str = "hour", **filters) -> DataFrame:
    bucket = times.floor_time("timestamp", n, unit).alias("time")
    return select_logs(logs, **filters).groupBy(bucket).agg(F.count("*").alias("count")).orderBy(F.desc("time"))


def log_search(logs: DataFrame, limit: int = 100, **filters) -> DataFrame:
    newest = select_logs(logs, **filters).orderBy(F.desc("timestamp"), F.desc("log_id")).limit(limit)
    return newest.select("log_id", "timestamp", "service_name", "severity_text", "trace_id", "body")


def distinct_values(df: DataFrame, column: str, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Non-empty values of a column, sorted."""
    seen = in_range(df, start, end, ts).select(column).filter((F.col(column).isNotNull()) & (F.col(column) != ""))
    return seen.distinct().orderBy(column)


def discover_page(df: DataFrame, columns: Sequence[str], filters: Sequence[tuple] = (), start=None, end=None,
                  page: int = 1, size: int = 50, ts: str = "timestamp", tie: str = "log_id",
                  where: Column | None = None) -> DataFrame:
    """One page of matching rows, newest first, with only the shown columns."""
    rows = apply_filters(in_range(df, start, end, ts), filters)
    if where is not None:
        rows = rows.filter(where)
    newest = rows.select(*dict.fromkeys([*columns, ts, tie])).orderBy(F.desc(ts), F.desc(tie))
    return newest.offset((page - 1) * size).limit(size).select(*columns)


def auto_interval(start: datetime, end: datetime) -> tuple[int, str]:
    """Histogram resolution for a time range: the first rung of the ladder that is reached."""
    months = (end.year - start.year) * 12 + end.month - start.month
    if (end.day, end.time()) < (start.day, start.time()):
        months -= 1
    seconds = (end - start).total_seconds()
    for (n, unit), resolution in INTERVAL_LADDER:
        if unit == "year":
            reached = months // 12
        elif unit == "month":
            reached = months
        else:
            reached = seconds // _UNIT_SECONDS[unit]
        if reached >= n:
            return resolution
    return 1, "second"


def histogram(df: DataFrame, n: int, unit: str, ts: str = "timestamp") -> DataFrame:
    """Counts per ``n``-unit bucket. Partial counts before the shuffle play the inner level's part."""
    return df.groupBy(times.floor_time(ts, n, unit).alias("bucket")).agg(F.count("*").alias("count")).orderBy("bucket")


def fill_gaps(hist: DataFrame, start: Column, end: Column, n: int, unit: str) -> DataFrame:
    """All buckets from ``start`` up to, not including, ``end``; absent ones are null.

    The bucket starts are generated day by day, so a long range at a fine step
    is spread over tasks instead of being one large array.
    """
    step = F.expr(f"INTERVAL {int(n)} {unit.upper()}")
    edge = hist.sparkSession.range(1).select(start.alias("_start"), end.alias("_end"))
    bounds = edge.select(times.floor_time("_start", n, unit).alias("_first"), "_end")
    if unit in ("second", "minute", "hour"):
        days = bounds.select("_first", "_end", F.explode(F.sequence(F.to_date("_first"), F.to_date("_end"))).alias("_day"))
        opened = F.col("_day").cast("timestamp_ntz")
        closed = F.timestamp_add("DAY", F.lit(1), opened) - F.expr("INTERVAL 1 SECOND")
        # One row per day so far: dealt out before the steps of each day are made.
        grid = days.repartition("_day").select("_first", "_end", F.explode(F.sequence(opened, closed, step)).alias("bucket"))
    else:
        grid = bounds.select("_first", "_end", F.explode(F.sequence("_first", "_end", step)).alias("bucket"))
    lone = (F.col("bucket") == F.col("_first"))
    grid = grid.filter((F.col("bucket") >= F.col("_first")) & ((F.col("bucket") < F.col("_end")) | lone)).select("bucket")
    return grid.join(hist, "bucket", "left").orderBy("bucket")


def total_hits(hist: DataFrame) -> DataFrame:
    return hist.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"))


def surrounding(df: DataFrame, anchor: Column, n: int = 5, ts: str = "timestamp", tie: str = "log_id",
                filters: Sequence[tuple] = ()) -> DataFrame:
    """``n`` rows strictly before and after the anchor; rows at the anchor's own time are the middle."""
    rows = apply_filters(df, filters)
    before = rows.filter(F.col(ts) < anchor).orderBy(F.desc(ts), F.desc(tie)).limit(n)
    after = rows.filter(F.col(ts) > anchor).orderBy(ts, tie).limit(n)
    middle = df.filter(F.col(ts) == anchor).orderBy(tie).limit(1)
    tagged = [part.withColumn("place", F.lit(place)) for part, place in ((before, "before"), (middle, "anchor"), (after, "after"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).orderBy(ts, tie)


def top_values(df: DataFrame, field: str, sample: int | None = None, k: int = 5, ts: str = "timestamp",
               tie: str = "log_id") -> DataFrame:
    """The most frequent values, with their share, among all rows or the newest ``sample``."""
    newest = df.select(ts, tie, F.coalesce(path(field).cast("string"), F.lit("")).alias("value"))
    if sample is not None:
        newest = newest.orderBy(F.desc(ts), F.desc(tie)).limit(sample)
    total = newest.agg(F.count("*")).scalar()
    counts = newest.groupBy("value").agg(F.count("*").alias("count"))
    return (counts.withColumn("pct", F.round(F.col("count") * 100 / total, 1))
            .orderBy(F.desc("count"), "value").limit(k))


def highlight_hits(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    return df.withColumns({f"{c}_marked": text.highlight(c, query) for c in columns})
