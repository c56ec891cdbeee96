"""Change capture, ingest and lifecycle jobs over table snapshots.

The row-by-row loops of a sync service become set-based joins: the planner
broadcasts a side only when its size allows it and shuffles on the key otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import times
from tidemark.sources.parted import PartedTable
from tidemark.sources.readers import dealt

FAST, NORMAL, IDLE = 5000, 1000, 500
#: States after which a load goes on.
LOAD_ACCEPTED = ("Success", "Publish Timeout")


def fill_sync_nulls(df: DataFrame) -> DataFrame:
    """Nulls as the sync writes them: '' for text, 0 for numbers."""
    def filled(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(f.name, F.lit("")).alias(f.name)
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        return F.col(f.name)
    return df.select(*[filled(f) for f in df.schema.fields])


def incremental_new(source: DataFrame, target: DataFrame, key: str, batch: int | None = None,
                    inclusive: bool = False, mark: Column | None = None) -> DataFrame:
    """The source rows above the target's highest key, or above ``mark`` where the caller keeps that key.

    Rows that arrive late with a smaller key are never taken. ``batch`` limits a pass to about so many rows; it ends
    with the last key it takes, so rows that share a key are never parted. ``inclusive`` also re-reads the highest key
    and drops what the target already has.
    """
    if mark is None:
        mark = target.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    if inclusive:
        rows = source.filter(F.col(key) >= mark).join(target.select(key), key, "left_anti")
    else:
        rows = source.filter(F.col(key) > mark)
    if batch is not None:
        last = rows.select(F.col(key).alias("_key")).orderBy("_key").limit(batch).agg(F.max("_key")).scalar()
        rows = rows.filter(F.col(key) <= last)
    return fill_sync_nulls(rows)


def instant(value: Column | datetime | str) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def pending_updates(source: DataFrame, since: Column | datetime | str, key: str = "order_id",
                    limit: int | None = None, since_key: Column | int | None = None) -> DataFrame:
    """Changed rows after the mark ``(since, since_key)``, all of them or the ``limit`` oldest.

    With a limit, a pass may end between rows that share an instant; hand its ``next_watermark`` with the key to the
    next pass, which then goes on inside that instant.
    """
    changed = source.filter(_is_pending(since, key, since_key)).select(key, "order_status", "updated_at")
    return changed if limit is None else changed.orderBy("updated_at", key).limit(limit)


def _is_pending(since: Column | datetime | str, key: str, since_key: Column | int | None = None) -> Column:
    after = F.col("updated_at") > instant(since)
    if since_key is not None:
        after |= (F.col("updated_at") == instant(since)) & (F.col(key) > since_key)
    return after & (F.col("updated_at") > F.col("created_at"))


def next_watermark(changes: DataFrame, since: Column | datetime | str, key: str = "order_id",
                   since_key: Column | int | None = None) -> DataFrame:
    """The mark after these changes: the newest instant and the highest key changed at it."""
    last = F.max(F.struct("updated_at", key))
    kept = F.lit(since_key) if not isinstance(since_key, Column) else since_key
    return changes.agg(last.alias("_last")).select(
        F.coalesce(F.col("_last.updated_at"), instant(since)).alias("watermark"),
        F.coalesce(F.col(f"_last.{key}"), kept).alias("watermark_key"))


def apply_updates(target: DataFrame, changes: DataFrame, key: str = "order_id") -> DataFrame:
    """Target with the newest changed status per key."""
    newest = changes.groupBy(key).agg(F.max_by("order_status", "updated_at").alias("_status"))
    return (target.join(newest, key, "left")
            .withColumn("order_status", F.coalesce("_status", "order_status"))
            .select(*target.columns))


def detect_deletes(target: DataFrame, source: DataFrame, key: str = "order_id", window: int | None = None) -> DataFrame:
    """Target keys that the source no longer has, among all of them or only the newest ``window``."""
    newest = target.select(key)
    if window is not None:
        newest = newest.orderBy(F.desc(key)).limit(window)
    return newest.join(dealt(source.select(key), key), key, "left_anti")


def apply_deletes(target: DataFrame, deleted: DataFrame, key: str = "order_id") -> DataFrame:
    return target.join(deleted.select(key), key, "left_anti")


def asked_states(keys: DataFrame, changes: DataFrame, key: str = "order_id") -> DataFrame:
    """``key, _status, _at``: one row for each key and each change; a key alone has no state."""
    state = changes.select(key, F.col("order_status").alias("_status"), F.col("updated_at").alias("_at"))
    return keys.select(key, *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("_status", "_at")]).unionByName(state)


def apply_asked(target: DataFrame, asked: DataFrame, key: str = "order_id", lost: DataFrame | None = None) -> DataFrame:
    """Target with the newest state asked for per key, without the keys that are not asked for, or without the ``lost`` ones.

    One row a key meets the target, in a single join. Null keys stay, as they equal no key.
    """
    newest = dealt(asked, key).groupBy(key).agg(F.max_by("_status", "_at").alias("_status"), F.count("*").alias("_asked"))
    met = target.join(newest, key, "left").withColumn("order_status", F.coalesce("_status", "order_status"))
    if lost is not None:
        return apply_deletes(met.select(*target.columns), lost, key)
    return met.filter(F.col("_asked").isNotNull() | F.col(key).isNull()).select(*target.columns)


def cdc_pass(target: DataFrame, source: DataFrame, since: Column | str, key: str = "order_id",
             batch: int | None = None, update_limit: int | None = None,
             window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One pass: new rows, then status changes, then deletes; ``(target', counts)``."""
    new = incremental_new(source.select(*target.columns), target, key, batch)
    grown = target.unionByName(new)
    changes = pending_updates(source, since, key, update_limit)
    gone = detect_deletes(grown, source, key, window)
    counts = new.agg(F.lit("new").alias("step"), F.count("*").alias("rows"))
    for step, df in (("updated", changes), ("deleted", gone)):
        counts = counts.unionByName(df.agg(F.lit(step).alias("step"), F.count("*").alias("rows")))
    if update_limit is None:  # the source tells keys and states in one pass
        asked = source.select(key, *[F.when(_is_pending(since, key), F.col(c)).alias(a) for c, a in (("order_status", "_status"), ("updated_at", "_at"))])
    else:
        asked = asked_states(source, changes, key)
    return apply_asked(grown, asked, key, None if window is None else gone), counts


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write per key wins; equal versions are settled by the row's own values.

    Only the changes are reduced, to one per key with a map-side ``max``, so a key with very many versions costs no more
    than any other. The base, which holds a key at most once, meets them in one join and is not aggregated.
    """
    rest = [c for c in base.columns if c not in (*keys, version)]
    row = [version, *rest]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*row)).alias("_last"))
    old = base.select(*keys, F.struct(*row).alias("_base"))
    # Null keys are keys of their own, as in a grouping.
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    on = same[0]
    for more in same[1:]:
        on &= more
    met = old.alias("b").join(last.alias("c"), on, "full_outer")
    winner = F.greatest("_base", "_last")
    found = met.select(*[F.coalesce(F.col(f"b.{k}"), F.col(f"c.{k}")).alias(k) for k in keys], winner.alias("_row"))
    return found.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in base.columns])


def upsert_parts(table: PartedTable, changes: DataFrame, keys: Sequence[str], version: str, part: Column, number: int) -> list[int]:
    """Upsert into a stored table: only the parts that hold a changed key are read and written again; returns them.

    ``part`` must depend on the keys alone (``key_part``) and stay the same for a table; ``number`` is the version to
    publish, so a repeated call repeats its result. The list of touched parts is at most as long as the table's.
    """
    touched = sorted(r[0] for r in changes.select(part).distinct().collect())
    base = table.read(touched, before=number)
    if base is None:
        base = changes.limit(0)
    table.replace(upsert(base, changes, keys, version), part, number, touched)
    return touched


def key_part(keys: Sequence[str], parts: int) -> Column:
    """Part of a row by the hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts))


def replication_lag(source: DataFrame, target: DataFrame, key: str = "order_id",
                    done: Column | int | None = None) -> DataFrame:
    """Key distance of target to source, the batch size it calls for, and progress."""
    top = source.agg(F.coalesce(F.max(key), F.lit(0)).alias("source_max"))
    mark = target.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    copied = target.agg(F.count("*")).scalar() if done is None else (done if isinstance(done, Column) else F.lit(done))
    lag = F.col("lag")
    return (top.withColumn("target_max", mark)
            .withColumn("lag", F.col("source_max") - F.col("target_max"))
            .withColumn("mode", F.when(lag > 100, "fast_forward").when(lag > 0, "realtime").otherwise("idle"))
            .withColumn("batch_size", F.when(lag > 100, FAST).when(lag > 0, NORMAL).otherwise(IDLE))
            .withColumn("progress_pct", F.coalesce(
                100.0 * (1.0 - lag / F.nullif(lag + copied, F.lit(0))), F.lit(100.0))))


MESSAGE_SCHEMA = """event_id string, session_id string, partner_id int, user_id int, event_type string, event_timestamp string,
  page_url string, device_info struct<type: string, os: string>,
  event_properties struct<product_name: string, category: string, price: variant, referrer: string>, _bad string"""


def parse_clickstream(messages: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """JSON messages flattened to fact rows; malformed ones keep ``is_valid = false``. Columns in ``keep`` stay.

    Each message is parsed once. It is malformed when it is not a JSON object or a
    field has the wrong type. Prices count only if they are JSON numbers. Campaign
    parameters are dropped.
    """
    parsed = F.from_json(value, MESSAGE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = messages.select(*keep, F.ltrim(value).startswith("{").alias("_object"), parsed.alias("m"))

    def text(field: str) -> Column:
        return F.coalesce(F.col(f"m.{field}"), F.lit(""))
    price = F.col("m.event_properties.price")
    is_number = F.schema_of_variant(price).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return rows.select(
        *keep, F.coalesce(F.col("_object") & F.col("m").isNotNull() & F.col("m._bad").isNull(), F.lit(False)).alias("is_valid"),
        text("event_id").alias("event_id"),
        F.try_to_timestamp(text("event_timestamp")).cast("timestamp_ntz").alias("event_time"),
        F.coalesce("m.partner_id", F.lit(0)).alias("partner_id"), text("session_id").alias("session_id"),
        F.coalesce("m.user_id", F.lit(0)).alias("user_id"), text("event_type").alias("event_type"),
        text("page_url").alias("page_url"), text("event_properties.product_name").alias("product_name"),
        text("event_properties.category").alias("product_category"),
        F.coalesce(F.when(is_number, F.try_variant_get(price, "$", "decimal(10,2)")),
                   F.lit(0).cast("decimal(10,2)")).alias("product_price"),
        text("event_properties.referrer").alias("referrer"), text("device_info.os").alias("user_agent"),
        text("device_info.type").alias("device_type"), F.lit("").alias("country"))


def ingest_clickstream(messages: DataFrame, value: str = "value") -> DataFrame:
    """Fact rows of all well-formed messages."""
    return parse_clickstream(messages, value).filter("is_valid").drop("is_valid")


def ingest_counters(messages: DataFrame, value: str = "value") -> DataFrame:
    return parse_clickstream(messages, value).agg(
        F.count("*").alias("consumed"), F.count_if("is_valid").alias("loaded"), F.count_if(~F.col("is_valid")).alias("errors"))


CHUNK_FILE_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("content_embedding", T.ArrayType(T.FloatType())),
    T.StructField("entity_names", T.ArrayType(T.StringType())), T.StructField("entity_types", T.ArrayType(T.StringType())),
    T.StructField("entities", T.VariantType()), T.StructField("relationships", T.VariantType()),
    T.StructField("multimodal_data", T.VariantType()), T.StructField("neighbor_ids", T.ArrayType(T.StringType())),
    T.StructField("related_entity_names", T.ArrayType(T.StringType())), T.StructField("doc_id", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()), T.StructField("page_number", T.IntegerType()),
])


def read_chunk_files(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """Chunk dumps: one JSON array per file, or JSON lines, which also split within a file."""
    return spark.read.schema(CHUNK_FILE_SCHEMA).option("multiLine", json_array).json(path)


def chunk_defaults(raw: DataFrame, tenant: str, corpus: str) -> DataFrame:
    """Tenant and corpus overridden, defaults for absent columns, JSON columns as text; an absent vector stays null."""
    def empty(name: str, element: str) -> Column:
        return F.coalesce(name, F.array().cast(f"array<{element}>")).alias(name)

    def as_json(name: str, default: str) -> Column:
        # A JSON string is already serialised and is taken as it is.
        plain = F.when(F.schema_of_variant(name) == "STRING", F.try_variant_get(name, "$", "string"))
        return F.coalesce(plain, F.to_json(name), F.lit(default)).alias(name)
    return raw.select(
        F.lit(tenant).alias("tenant_id"), F.lit(corpus).alias("corpus_id"), "row_id",
        F.coalesce("content_type", F.lit("text")).alias("content_type"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.when(F.size("content_embedding") > 0, F.col("content_embedding")).alias("content_embedding"), empty("entity_names", "string"), empty("entity_types", "string"),
        as_json("entities", "[]"), as_json("relationships", "[]"), as_json("multimodal_data", "{}"),
        empty("neighbor_ids", "string"), empty("related_entity_names", "string"),
        F.coalesce("doc_id", F.lit("")).alias("doc_id"),
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce("page_number", F.lit(0)).alias("page_number"))


def write_chunk_arrays(chunks: DataFrame, path: str, rows_per_file: int = 500) -> None:
    """Chunk dumps in the array form, one JSON array of at most about ``rows_per_file`` rows a file.

    An array is one task's when it is read, so a dump of many small files loads in parallel.
    """
    files = F.greatest(F.lit(1), F.ceil(chunks.agg(F.count("*")).scalar() / rows_per_file))
    dealt = chunks.select(F.pmod(F.xxhash64("row_id"), files).alias("_file"), F.to_json(F.struct("*")).alias("_row"))
    arrays = dealt.groupBy("_file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("_row"), ","), F.lit("]")).alias("value"))
    # One line a partition folder, hence one array a file.
    arrays.write.partitionBy("_file").text(path)


def load_chunks(spark: SparkSession, path: str, tenant: str, corpus: str, json_array: bool = True,
                target: DataFrame | None = None) -> DataFrame:
    """Load chunk files; a target that already has rows is returned unchanged."""
    if target is not None and not target.isEmpty():
        return target
    return chunk_defaults(read_chunk_files(spark, path, json_array), tenant, corpus)


def load_report(rows: DataFrame, batch: str, valid: Column, payload: Column) -> DataFrame:
    """Loaded and filtered rows and bytes per batch, and for the whole load (``is_total = 1``)."""
    flagged = rows.select(F.col(batch).alias("batch"), F.coalesce(valid, F.lit(False)).alias("_ok"),
                          F.octet_length(payload).cast("long").alias("_bytes"))
    return flagged.rollup("batch").agg(
        F.count("*").alias("total_rows"), F.count_if("_ok").alias("loaded_rows"),
        F.count_if(~F.col("_ok")).alias("filtered_rows"), F.sum("_bytes").alias("load_bytes"),
        F.grouping("batch").cast("int").alias("is_total"))


def load_outcome(reports: DataFrame, accepted: Sequence[str] = LOAD_ACCEPTED) -> DataFrame:
    """What a load of batches ``(batch, status, loaded_rows, filtered_rows, load_bytes)`` came to: it goes on over accepted
    states and stops at the first other one, whose batch is ``failed_batch`` (null after a whole load).

    Batches run in the order of ``batch``; only those before the stop count. A null status stops the load.
    """
    refused = ~F.coalesce(F.col("status").isin(*accepted), F.lit(False))
    failed = reports.filter(refused).agg(F.min("batch")).scalar()
    counted = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loaded_rows", "filtered_rows", "load_bytes")]
    done = reports.withColumn("_failed", failed).filter(F.col("_failed").isNull() | (F.col("batch") < F.col("_failed")))
    return done.agg(F.count("*").alias("batches"), *counted).withColumn("failed_batch", failed)


def write_partitioned(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Write by day; rows of a day are gathered into few files through AQE's rebalance."""
    daily = df.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date")
    daily.write.mode(mode).partitionBy("event_date").parquet(path)


def with_partition_check(df: DataFrame, ts: str, as_of=None, back: int = 7, ahead: int = 3) -> DataFrame:
    """Marks rows whose day partition exists (``back`` days back to ``ahead`` days ahead)."""
    today = F.to_date(times.as_of(df, ts, as_of))
    day = F.to_date(ts)
    inside = (day >= F.date_sub(today, back)) & (day <= F.date_add(today, ahead))
    return df.withColumn("event_date", day).withColumn("accepted", F.coalesce(inside, F.lit(False)))


def retention(df: DataFrame, ts: str, as_of=None, back: int = 7, ahead: int = 3) -> DataFrame:
    return with_partition_check(df, ts, as_of, back, ahead).filter("accepted").drop("accepted")


def missing_days(tables: Mapping[str, tuple[DataFrame, str]], as_of: Column, days: int) -> DataFrame:
    """Day partitions of the last ``days`` full days per table, with row counts; 0 = no data yet."""
    counts = None
    for name, (df, ts) in tables.items():
        per_day = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table_name"), "day", "n")
        counts = per_day if counts is None else counts.unionByName(per_day)
    spark = counts.sparkSession
    today = F.to_date(as_of)
    grid = (spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days), F.date_sub(today, 1))).alias("day"))
            .select(F.explode(F.array(*[F.lit(t) for t in tables])).alias("table_name"), "day"))
    return grid.join(counts, ["table_name", "day"], "left").select(
        "table_name", F.concat(F.lit("p"), F.date_format("day", "yyyyMMdd")).alias("partition_name"),
        F.col("day").alias("from_day"), F.date_add("day", 1).alias("to_day"),
        F.coalesce("n", F.lit(0)).alias("row_count"), F.col("n").isNull().alias("is_missing"))


def ttl_cleanup(df: DataFrame, ts: str, name: str, days: int = 3, as_of=None) -> tuple[DataFrame, DataFrame]:
    """``(rows kept, (table_name, deleted_count))``."""
    old = F.col(ts) < times.ago(times.as_of(df, ts, as_of), days, "day")
    return (df.filter(~old),
            df.agg(F.lit(name).alias("table_name"), F.count_if(old).alias("deleted_count")))


def insert_attributes(attributes: Column | str, defaults: Mapping[str, str]) -> Column:
    """Add the default attributes whose key is absent."""
    current = F.coalesce(F.col(attributes) if isinstance(attributes, str) else attributes,
                         F.create_map().cast("map<string,string>"))
    wanted = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_concat(F.map_filter(wanted, lambda k, _: ~F.map_contains_key(current, k)), current)


def row_uid(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row as JSON with sorted keys; nulls are written out."""
    names = sorted(columns or df.columns)
    types = dict(df.dtypes)
    stable = [F.col(c).cast("string").alias(c) if types[c].startswith(("timestamp", "date")) else F.col(c) for c in names]
    return F.sha2(F.to_json(F.struct(*stable), {"ignoreNullFields": "false"}), 256)
