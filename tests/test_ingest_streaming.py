"""Ingest rules, and streaming jobs over several micro-batches against their batch twins."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import commerce, graph, ingest, logs
from tidemark.session import work_path
from tidemark.sources.readers import day_partitions, parquet_stream, text_stream
from tidemark.streaming import jobs

T0 = datetime(2024, 1, 1)
ORDER = "order_id long, order_status string, created_at timestamp_ntz, updated_at timestamp_ntz"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_messages(spark):
    good = {"event_id": "1", "partner_id": 44, "user_id": 7, "event_timestamp": "2024-01-01 10:00:00",
            "event_properties": {"price": 9.5, "referrer": "r"}, "device_info": {"type": "mobile", "os": "x"}}
    texts = [json.dumps(good), json.dumps({**good, "event_id": "2", "event_properties": {"price": "9.5"}}),
             json.dumps({**good, "partner_id": "44"}), '{"event_id":', "[1]", "null", "", json.dumps({"event_id": "3"})]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = ingest.ingest_clickstream(df)
    assert [(a, float(b), c, d) for a, b, c, d in rows(got, "event_id", "product_price", "device_type", "user_agent")] == [
        ("1", 9.5, "mobile", "x"), ("2", 0.0, "mobile", "x"), ("3", 0.0, "", "")]
    counters = ingest.ingest_counters(df).first()
    assert (counters["consumed"], counters["loaded"], counters["errors"]) == (8, 3, 5)


def test_incremental_inclusive_and_null_fill(spark):
    source = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "c", 3.0)], "k long, s string, d double")
    target = source.filter("k <= 1")
    assert rows(ingest.incremental_new(source, target, "k", 1), "k", "s", "d") == [(2, "", 0.0)]
    late = spark.createDataFrame([(1, "a", 1.0)], "k long, s string, d double")
    assert rows(ingest.incremental_new(source, late, "k", 9, inclusive=True), "k") == [(2,), (3,)]


def test_upsert_last_version_wins(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v int, s string")
    changes = spark.createDataFrame([(1, 3, "z"), (1, 2, "y"), (3, 1, "n")], "k long, v int, s string")
    assert rows(ingest.upsert(base, changes, ["k"], "v"), "k", "s") == [(1, "z"), (2, "b"), (3, "n")]


def test_chunk_array_file_and_guard(spark, tmp_path):
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps([{"row_id": "a", "entities": [{"n": 1}], "chunk_index": None}, {"row_id": "b", "relationships": "[1]"}]))
    loaded = ingest.load_chunks(spark, str(path), "t", "c")
    assert rows(loaded, "row_id", "content_type", "entities", "relationships", "chunk_index") == [
        ("a", "text", '[{"n":1}]', "[]", 0), ("b", "text", "[]", "[1]", 0)]
    assert ingest.load_chunks(spark, "/nowhere", "t", "c", target=loaded) is loaded


def test_day_partitions(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(days=i)) for i in range(20)], "id int, ts timestamp_ntz")
    path = work_path(spark, "days")
    ingest.write_partitioned(ingest.retention(df, "ts", T0 + timedelta(days=10)), path, "ts")
    back = day_partitions(spark, path, "2024-01-05", "2024-01-06")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(3, 14))
    assert sorted(r["id"] for r in back.collect()) == [4, 5]
    assert "PartitionFilters: [isnotnull(event_date" in back._jdf.queryExecution().toString()


def test_interval_ladder():
    ranges = [(timedelta(days=1200), (1, "month")), (timedelta(days=400), (1, "week")), (timedelta(days=40), (1, "day")),
              (timedelta(days=8), (12, "hour")), (timedelta(days=5), (3, "hour")), (timedelta(days=1), (1, "hour")),
              (timedelta(hours=17), (30, "minute")), (timedelta(hours=9), (10, "minute")), (timedelta(hours=2), (5, "minute")),
              (timedelta(minutes=40), (1, "minute")), (timedelta(minutes=14), (30, "second")), (timedelta(minutes=7), (10, "second")),
              (timedelta(minutes=4), (5, "second")), (timedelta(minutes=1), (1, "second"))]
    assert [logs.auto_interval(T0, T0 + span) for span, _ in ranges] == [step for _, step in ranges]


def test_gap_filling_excludes_the_end(spark):
    hist = spark.createDataFrame([(T0 + timedelta(hours=2), 5)], "bucket timestamp_ntz, count long")
    lit = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    filled = logs.fill_gaps(hist, lit(T0 + timedelta(minutes=5)), lit(T0 + timedelta(hours=4)), 1, "hour")
    assert [(r["bucket"].hour, r["count"]) for r in filled.collect()] == [(0, None), (1, None), (2, 5), (3, None)]


def in_files(df, folder, column, n):
    """Write ``n`` separate files, so that a stream sees ``n`` micro-batches."""
    for i in range(n):
        df.filter(F.pmod(F.hash(column), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def clicks(spark):
    kinds = ["view", "cart", "purchase"]
    data = [(str(i), 44 + i % 2, kinds[i % 3], T0 + timedelta(hours=i), float(i)) for i in range(400)]
    return spark.createDataFrame(data, "event_id string, partner_id int, event_type string, event_time timestamp_ntz, product_price double")


def test_stream_funnel_and_minutes_over_batches(spark, clicks):
    source, out = work_path(spark, "clicks"), work_path(spark, "out")
    in_files(clicks, source, "event_id", 3)
    stream = parquet_stream(spark, source, clicks.schema, max_files=1).withColumn("event_time", F.col("event_time").cast("timestamp"))
    jobs.refresh_funnel(stream, f"{out}/funnel", every=None).awaitTermination()
    cols = ("partner_id", "views", "carts", "purchases")
    assert rows(jobs.funnel_view(spark, f"{out}/funnel"), *cols) == rows(commerce.conversion_funnel(clicks), *cols)

    keys = ["partner_id", "minute_start"]
    jobs.keep_updated(jobs.minute_counts(stream, "30 days"), f"{out}/minutes", keys).awaitTermination()
    now = jobs.current(spark, f"{out}/minutes", keys)
    assert now.agg(F.sum("count"), F.sum("revenue")).first()[:] == (400, float(sum(range(400))))

    jobs.store(jobs.distinct_events(stream.unionByName(stream), lateness="30 days"), f"{out}/distinct").awaitTermination()
    assert spark.read.parquet(f"{out}/distinct/rows").count() == 400


def test_stream_json_ingest_over_batches(spark, tmp_path):
    for f in range(3):
        lines = [json.dumps({"event_id": f"{f}-{i}", "partner_id": 44, "event_timestamp": "2024-01-01 00:00:00"}) for i in range(20)]
        (tmp_path / f"m{f}.txt").write_text("\n".join(lines + ["{broken"]))
    out = work_path(spark, "facts")
    for _ in range(2):  # a restart finds nothing new
        jobs.ingest_clickstream(text_stream(spark, str(tmp_path), 1), out).awaitTermination()
    assert jobs.facts(spark, out).count() == 60
    assert rows(jobs.rejects(spark, out), "value") == [("{broken",)] * 3
    assert rows(jobs.counters(spark, out), "batch_id", "consumed", "loaded", "errors") == [(k, 21, 20, 1) for k in range(3)]


def test_stream_indexes_over_batches(spark):
    data = [("t", "c", f"{d}-{i}", str(d), i, [f"Entity{(d + i) % 7}", "Everywhere"], "[]") for d in range(6) for i in range(9)]
    chunks = spark.createDataFrame(data, "tenant_id string, corpus_id string, row_id string, doc_id string, chunk_index int, "
                                         "entity_names array<string>, relationships string")
    source, out = work_path(spark, "chunks"), work_path(spark, "index")
    in_files(chunks, source, "row_id", 3)
    stream = parquet_stream(spark, source, chunks.schema, max_files=1)
    jobs.refresh_indexes(stream, out, max_freq=50).awaitTermination()
    views = jobs.index_views(spark, out)
    assert rows(views["neighbors"], "src_chunk", "neighbor_chunks") == rows(graph.structural_neighbors(chunks), "src_chunk", "neighbor_chunks")
    assert rows(views["entities"], "entity_name", "freq", "chunk_ids") == rows(graph.entity_index(chunks, 50), "entity_name", "freq", "chunk_ids")


def test_cdc_loop_equals_passes(spark):
    source = spark.createDataFrame([
        (i, "shipped" if i % 4 == 0 else "pending", T0, T0 + timedelta(hours=i if i % 4 == 0 else 0)) for i in range(60) if i % 7], ORDER)
    base = spark.createDataFrame([(i, "pending", T0, T0) for i in range(30)], ORDER)
    limits = dict(batch=8, update_limit=3, window=10)
    mark = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    expected = base
    for _ in range(3):
        changes = ingest.pending_updates(source, mark, limit=3)
        expected, _ = ingest.cdc_pass(expected, source, mark, **limits)
        mark = F.lit(str(ingest.next_watermark(changes, mark).first()[0])).cast("timestamp_ntz")
    ticks, out = work_path(spark, "ticks"), work_path(spark, "cdc")
    in_files(spark.range(30), ticks, "id", 3)
    jobs.cdc_loop(parquet_stream(spark, ticks, spark.range(1).schema, max_files=1), lambda: source, base, out,
                  "2024-01-01 00:00:00", every=None, **limits).awaitTermination()
    want = rows(expected, "order_id", "order_status")
    assert rows(jobs.cdc_view(spark, out, base), "order_id", "order_status") == want
    assert rows(jobs.compact(spark, out, base, work_path(spark, "base")), "order_id", "order_status") == want


def test_tied_updates_are_all_applied(spark):
    """150 changes at one instant: at once without a limit, in three limited passes with the key in the mark."""
    source = spark.createDataFrame([(i, "shipped", T0, T0 + timedelta(hours=1)) for i in range(150)], ORDER)
    start = F.lit(str(T0)).cast("timestamp_ntz")
    assert ingest.pending_updates(source, start).count() == 150
    seen, mark, key = set(), start, None
    for _ in range(3):
        changes = ingest.pending_updates(source, mark, limit=60, since_key=key)
        seen |= {r["order_id"] for r in changes.collect()}
        last = ingest.next_watermark(changes, mark).first()
        mark, key = F.lit(str(last["watermark"])).cast("timestamp_ntz"), last["watermark_key"]
    assert seen == set(range(150))
    assert ingest.detect_deletes(source.select("order_id"), source.filter("order_id >= 140")).count() == 140


def test_batches_end_with_a_key(spark):
    source = spark.createDataFrame([(k // 5, k) for k in range(40)], "k long, v long")
    got = ingest.incremental_new(source, source.filter("k < 2"), "k", batch=7)
    assert rows(got, "v") == [(v,) for v in range(10, 20)]


def test_cdc_loop_over_a_moving_source(spark):
    """A row changes between the reads of a tick: nothing is lost, and the next tick applies it."""
    base = spark.createDataFrame([(i, "pending", T0, T0) for i in range(20)], ORDER)
    hour = timedelta(hours=1)
    early = spark.createDataFrame([(i, "shipped" if i < 5 else "pending", T0, T0 + (hour if i < 5 else timedelta())) for i in range(20)], ORDER)
    late = spark.createDataFrame([(i, "shipped" if i < 9 else "pending", T0, T0 + (hour if i < 9 else timedelta())) for i in range(22)], ORDER)
    reads = iter([early, late, late])
    ticks, out = work_path(spark, "ticks"), work_path(spark, "cdc")
    in_files(spark.range(30), ticks, "id", 3)
    jobs.cdc_loop(parquet_stream(spark, ticks, spark.range(1).schema, max_files=1), lambda: next(reads, late), base, out,
                  str(T0), every=None).awaitTermination()
    assert rows(jobs.cdc_view(spark, out, base), "order_id", "order_status") == rows(late, "order_id", "order_status")
    counts = spark.read.parquet(f"{out}/counts").groupBy("step").agg(F.sum("rows").alias("n"))
    assert rows(counts, "step", "n") == [("deleted", 0), ("new", 2), ("updated", 9)]
    new_base = jobs.compact(spark, out, base, work_path(spark, "base"))
    assert jobs.cdc_view(spark, out, new_base).count() == 22


def test_status_requests_do_not_double_orders(spark):
    orders = spark.createDataFrame([(1, "pending", T0), (2, "pending", T0)], "order_id long, order_status string, updated_at timestamp_ntz")
    asked = spark.createDataFrame([(1, "shipped", 1), (1, "cancelled", 2), (1, "lost", 3), (9, "shipped", 4)], "order_id long, new_status string, request int")
    now = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    after = commerce.apply_status(orders, commerce.set_status(orders, asked), version="request", now=now)
    assert rows(after, "order_id", "order_status", "updated_at") == [(1, "cancelled", datetime(2024, 5, 1)), (2, "pending", T0)]


def test_absent_vectors_stay_null(spark, tmp_path):
    path = tmp_path / "chunks.json"
    path.write_text(json.dumps([{"row_id": "a", "content_embedding": [1.0, 2.0]}, {"row_id": "b"}, {"row_id": "c", "content_embedding": []}]))
    loaded = ingest.load_chunks(spark, str(path), "t", "c")
    assert rows(loaded, "row_id", "content_embedding") == [("a", [1.0, 2.0]), ("b", None), ("c", None)]


def test_a_load_stops_at_the_first_refused_batch(spark):
    schema = "batch long, status string, loaded_rows long, filtered_rows long, load_bytes long"
    rows_ = [(1, "Success", 10, 1, 100), (2, "Publish Timeout", 20, 0, 200), (3, "Fail", 5, 5, 50), (4, "Success", 7, 0, 70)]
    reports = spark.createDataFrame(rows_, schema)
    assert tuple(ingest.load_outcome(reports).first()) == (2, 30, 1, 300, 3)
    assert tuple(ingest.load_outcome(reports.filter("batch <> 3")).first()) == (3, 37, 1, 370, None)
    assert tuple(ingest.load_outcome(reports.withColumn("status", F.lit(None).cast("string"))).first()) == (0, 0, 0, 0, 1)
    assert tuple(ingest.load_outcome(reports.limit(0)).first()) == (0, 0, 0, 0, None)


def test_array_dumps_load_in_many_files(spark):
    chunks = spark.createDataFrame([(f"r{k}", f'te"xt {k}\n', ["a", "b"], k) for k in range(95)], "row_id string, content string, entity_names array<string>, chunk_index int")
    folder = work_path(spark, "arrays")
    ingest.write_chunk_arrays(chunks, folder, rows_per_file=10)
    loaded = ingest.load_chunks(spark, folder, "t", "c")
    assert len(ingest.read_chunk_files(spark, folder).inputFiles()) == 10
    assert rows(loaded, "row_id", "content", "chunk_index") == rows(chunks, "row_id", "content", "chunk_index")
    assert ingest.load_chunks(spark, folder, "u", "c", target=loaded) is loaded
