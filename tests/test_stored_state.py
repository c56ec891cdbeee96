"""Stored state that changes by parts or levels: replays, what a batch touches, and equality with the batch results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import commerce, graph, ingest
from tidemark.operators.digests import RangedTable
from tidemark.session import work_path
from tidemark.sources.parted import LevelledTable, PartedTable
from tidemark.sources.readers import parquet_stream
from tidemark.streaming import jobs

T0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_levels_grow_with_the_logarithm(spark):
    folder = work_path(spark, "levels")
    table = LevelledTable(spark, folder, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    for version in range(20):
        batch = spark.createDataFrame([(version % 3, 1), (9, 1)], "k long, n long")
        table.add(batch, version)
        if version in (7, 15, 19):  # a replay takes its own place
            table.add(batch, version)
        assert len(table.parts()) <= 9
    assert rows(table.read().groupBy("k").agg(F.sum("n").alias("n")), "k", "n") == [(0, 7), (1, 7), (2, 6), (9, 20)]
    assert len(LevelledTable(spark, folder).versions()) == 2


def test_parts_are_replaced_alone(spark):
    table = PartedTable(spark, work_path(spark, "parts"))
    assert table.read() is None
    part = F.col("k") % 4
    table.replace(spark.range(40).withColumnRenamed("id", "k"), part, 0)
    before = table._list()["parts"]
    table.replace(spark.createDataFrame([(101,)], "k long"), part, 1, [1, 2])
    after = table._list()["parts"]
    assert {p for p in before if before[p] != after.get(p)} == {"1", "2"} and "2" not in after
    assert rows(table.read(), "k") == sorted([(k,) for k in range(40) if k % 4 in (0, 3)] + [(101,)])
    assert table.read([2]).count() == 0 and table.read(before=1).count() == 40 and table.read([0], before=1).count() == 10


def test_upsert_touches_the_parts_of_its_keys(spark):
    table, part = PartedTable(spark, work_path(spark, "upsert")), ingest.key_part(["k"], 64)
    base = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit("old").alias("s"))
    table.replace(base, part, 0)
    before = table._list()["parts"]
    changes = spark.createDataFrame([(k * 7, 2, "new") for k in range(8)] + [(90_001, 1, "new"), (3, 0, "late")], "k long, v int, s string")
    for _ in range(2):
        touched = ingest.upsert_parts(table, changes, ["k"], "v", part, 1)
    after = table._list()["parts"]
    assert len(touched) <= 10 and {int(p) for p in after if after[p] != before.get(p)} == set(touched)
    assert rows(table.read(), "k", "v", "s") == rows(ingest.upsert(base, changes, ["k"], "v"), "k", "v", "s")
    assert table.read().filter("s = 'new'").count() == 9
    fresh = PartedTable(spark, work_path(spark, "upsert"))
    ingest.upsert_parts(fresh, changes, ["k"], "v", part, 0)
    assert fresh.read().count() == 10


ORDER = "order_id long, order_status string, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_ticks_read_only_ranges_that_changed(spark):
    """Three changes among a million keys: three ranges of 245 are read, and the target follows."""
    folder = work_path(spark, "ranges")
    source, target = (RangedTable(spark, f"{folder}/{side}", "order_id") for side in ("source", "target"))
    at = F.lit(str(T0)).cast("timestamp_ntz")
    base = spark.range(1_000_000).select(F.col("id").alias("order_id"), F.lit("pending").alias("order_status"), at.alias("created_at"), at.alias("updated_at"))
    target.replace(base, 0)
    source.replace(base, 0)

    def tick(number):
        spark.range(number, number + 1).write.mode("append").parquet(f"{folder}/ticks")
        stream = parquet_stream(spark, f"{folder}/ticks", spark.range(1).schema)
        jobs.cdc_ranges(stream, source, target, folder, str(T0), every=None).awaitTermination()
        return jobs.cdc_counts(spark, folder).filter(F.col("tick") == number).first()[1:5]

    assert tick(0) == (0, 0, 0, 245)
    assert tick(1) == (0, 0, 0, 0)
    hour = F.lit(str(T0 + timedelta(hours=1))).cast("timestamp_ntz")
    touched = source.touched(spark.createDataFrame([(5,), (500_000,), (999_999,)], "order_id long"))
    moved = source.read(touched).filter("order_id <> 5").withColumns({
        "order_status": F.when(F.col("order_id") == 500_000, "shipped").otherwise(F.col("order_status")),
        "updated_at": F.when(F.col("order_id") == 500_000, hour).otherwise(F.col("updated_at"))})
    moved = moved.unionByName(spark.createDataFrame([(1_000_000, "pending", T0, T0)], ORDER))
    source.replace(moved, 1, touched)
    assert len(touched) == 3 and tick(2) == (1, 1, 1, 3)
    assert target.read().count() == 1_000_000 and target.read().filter("order_id = 5").isEmpty()
    assert rows(target.read().filter("order_status = 'shipped'"), "order_id") == [(500_000,)]
    assert not source.tree.differing(source.tree) and len(target.tree.differing(source.tree)) == 1  # updated_at is not copied


def test_null_and_negative_keys_have_ranges(spark):
    a, b = (RangedTable(spark, work_path(spark, "odd"), "k") for _ in range(2))
    data = spark.createDataFrame([(None, "x"), (-1, "y"), (-2**63, "z"), (2**63 - 1, "w"), (0, None)], "k long, s string")
    a.replace(data, 0)
    b.replace(data.withColumn("s", F.when(F.col("k") == -1, "changed").otherwise(F.col("s"))), 0)
    assert a.tree.differing(b.tree) == [-1] and rows(a.read([-1]), "k") == [(-1,)]
    a.replace(data.limit(0), 1)
    assert a.read().isEmpty() and len(a.tree.differing(b.tree)) == 5


def test_funnel_follows_the_batches(spark):
    """Over 16 batches and 10 days the view is the batch funnel of all rows so far, to the microsecond."""
    folder, kinds = work_path(spark, "funnel"), ["view", "cart", "purchase", "other"]
    data = [(str(i), 44 + i % 3, kinds[i % 4], T0 + timedelta(seconds=2160 * i + i % 7, microseconds=i), 1.0) for i in range(400)]
    schema = "event_id string, partner_id int, event_type string, event_time timestamp_ntz, product_price double"
    cols, seen, folders = ("partner_id", "views", "carts", "purchases"), [], []
    for version in range(16):
        part = data[version * 25:(version + 1) * 25] + data[max(0, version * 25 - 60):version * 25:30]  # some come late
        seen += part
        for _ in range(2 if version in (3, 8) else 1):
            jobs.add_to_funnel(spark.createDataFrame(part, schema), folder, version, 3)
        folders.append(len(jobs._partials(spark, folder, 3).parts()))
        if version % 5 == 0:
            assert rows(jobs.funnel_view(spark, folder, 3), *cols) == rows(commerce.conversion_funnel(spark.createDataFrame(seen, schema), days=3), *cols)
    assert max(folders) <= 9
    assert jobs._partials(spark, folder, 3).read().agg(F.min("minute")).first()[0] >= T0 + timedelta(days=6, hours=20)  # a merge drops what expired
    empty = work_path(spark, "funnel")
    jobs.add_to_funnel(spark.createDataFrame([], schema), empty, 0)
    assert jobs.funnel_view(spark, empty).count() == 0


def test_commits_read_a_bounded_number_of_files(spark, monkeypatch):
    """Each of 20 commits touches one document: the files it reads do not grow with the commits before it."""
    schema = ("tenant_id string, corpus_id string, row_id string, doc_id string, chunk_index int, entity_names array<string>, relationships string")
    source, out = work_path(spark, "commits"), work_path(spark, "index")
    data = []
    for d in range(20):
        part = [("t", "c", f"{d}-{i}", str(d % 15), d * 3 + i, [f"E{d % 5}", f"F{i}"], "[]") for i in range(3)]
        data += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    plain, opened = PartedTable.read, []

    def counted(self, parts=None, before=None):
        found = plain(self, parts, before)
        opened[-1] += len(found.inputFiles()) if found is not None and parts is not None else 0
        return found
    added = LevelledTable.add

    def commit(self, df, version):
        opened.append(0)
        return added(self, df, version)
    monkeypatch.setattr(PartedTable, "read", counted)
    monkeypatch.setattr(LevelledTable, "add", commit)
    jobs.refresh_indexes(parquet_stream(spark, source, spark.createDataFrame([], schema).schema, max_files=1), out, max_freq=11, parts=16).awaitTermination()
    assert len(opened) == 20 and max(opened) <= 8
    views, chunks = jobs.index_views(spark, out), spark.createDataFrame(data, schema)
    assert rows(views["neighbors"], "src_chunk", "neighbor_chunks") == rows(graph.structural_neighbors(chunks), "src_chunk", "neighbor_chunks")
    assert rows(views["entities"], "entity_name", "freq", "chunk_ids") == rows(graph.entity_index(chunks, 11), "entity_name", "freq", "chunk_ids")


def test_percentiles_follow_the_stream(spark):
    """Five batches: the folded sketches are within the stated bound of the exact ranks, for all minutes and for some."""
    import bisect
    schema = "kind string, event_timestamp string, ingest_time timestamp_ntz"
    data = []
    for i in range(5000):
        made = T0 + timedelta(seconds=i)
        data.append(("a" if i % 3 else "b", made.isoformat(), made + timedelta(milliseconds=(i * 7919) % 5000)))
    source, out = work_path(spark, "events"), work_path(spark, "sketches")
    for k in range(5):
        spark.createDataFrame(data[k::5], schema).coalesce(1).write.mode("append").parquet(source)
    stream = parquet_stream(spark, source, spark.createDataFrame([], schema).schema, max_files=1)
    jobs.keep_percentiles(stream, out, ["kind"]).awaitTermination()
    for first, last in ((None, None), (str(T0 + timedelta(minutes=10)), str(T0 + timedelta(minutes=30)))):
        for r in jobs.live_percentiles(spark, out, ["kind"], first, last).collect():
            inside = [d for d in data if d[0] == r["kind"] and (first is None or timedelta(minutes=10) <= d[2] - T0 < timedelta(minutes=31))]
            waits = sorted(int((d[2] - datetime.fromisoformat(d[1])) / timedelta(milliseconds=1)) for d in inside)
            assert r["events"] == len(waits) and r["min_ms"] == waits[0]
            for p, value in zip((0.5, 0.9, 0.95, 0.99, 0.999), r["percentiles"]):
                assert bisect.bisect_left(waits, value) - 0.01 * len(waits) <= p * len(waits) <= bisect.bisect_right(waits, value) + 0.01 * len(waits) + 1
