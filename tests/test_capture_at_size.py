"""Change capture: what a task sorts is dealt by key and not merged again, and a line's order is counted once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.operators.digests import RangedTable
from tidemark.plans.ingest import _source
from tidemark.session import work_path
from tidemark.sources import files
from tidemark.sources.readers import parquet_stream
from tidemark.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture
def shuffled(spark):
    """Joins as on large tables, where no side is broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def orders(spark, shipped):
    at = F.lit(str(T0)).cast("timestamp_ntz")
    now = F.col("id") < shipped
    return spark.range(2000).select(F.col("id").alias("order_id"), F.when(now, "shipped").otherwise("pending").alias("order_status"),
                                    at.alias("created_at"), F.when(now, F.lit(str(T0 + timedelta(hours=1))).cast("timestamp_ntz")).otherwise(at).alias("updated_at"))


def test_capture_loop_deals_by_key(spark, shuffled):
    """lost keys, log and view keep all tasks of the shuffle, where one merged task sorted everything."""
    source, base = orders(spark, 900).filter("order_id % 5 <> 0"), orders(spark, 0).filter("order_id < 1800")
    assert ingest.detect_deletes(base, source).rdd.getNumPartitions() == shuffled
    ticks, out = work_path(spark, "ticks"), work_path(spark, "cdc")
    spark.range(1).write.parquet(ticks)
    jobs.cdc_loop(parquet_stream(spark, ticks, spark.range(1).schema), lambda: source, base, out, str(T0), every=None).awaitTermination()
    written = [n for n in files.names(spark, f"{out}/log/batch_id=0") if n.endswith(".parquet")]
    assert len(written) == shuffled
    view = sorted((r["order_id"], r["order_status"]) for r in jobs.cdc_view(spark, out, base).collect())
    assert view == sorted((r["order_id"], r["order_status"]) for r in source.collect())


def test_lines_are_counted_once_before_the_shuffle(spark, sf, shuffled):
    """the source's order keys leave a task once, not once a line."""
    plan = _source(spark, f"{sf}/")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(keys=[order_id") == 2  # one before the exchange, one after


def test_ranges_share_folders(spark):
    """245 ranges lie in four folders, not in one each; a change leaves the other ranges of its folder as they are."""
    table = RangedTable(spark, work_path(spark, "shared"), "k")
    rows = spark.range(1_000_000).select(F.col("id").alias("k"), F.lit("old").alias("s"))
    table.replace(rows, 0)
    assert len(table.rows._list()["parts"]) == 4 and table.tree.levels[0].read().count() == 245
    touched = table.touched(spark.createDataFrame([(5,), (5000,)], "k long"))
    table.replace(table.read(touched).filter("k <> 5").withColumn("s", F.lit("new")), 1, touched)
    assert touched == [0, 1] and table.read().count() == 999_999
    assert table.read([1]).count() == 4096 and table.read().filter("s = 'new'").agg(F.count("*"), F.max("k")).first()[:] == (8191, 8191)
    again = RangedTable(spark, work_path(spark, "shared"), "k")
    again.replace(rows, 0)
    assert sorted(again.tree.differing(table.tree)) == [0, 1]


def test_a_pass_joins_the_target_once(spark, shuffled):
    """changes and lost keys meet the target in one join, dealt by key; before there were three."""
    source, base = orders(spark, 900).filter("order_id % 5 <> 0"), orders(spark, 0).filter("order_id < 1800")
    nothing = spark.createDataFrame([(None, "odd", T0, T0)], "order_id long, order_status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    after, counts = ingest.cdc_pass(base.unionByName(nothing), source, str(T0))
    assert after._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    assert after.rdd.getNumPartitions() == shuffled
    want = [(r["order_id"], r["order_status"]) for r in source.collect()]
    assert sorted(((r["order_id"], r["order_status"]) for r in after.filter("order_id IS NOT NULL").collect())) == sorted(want)
    assert after.filter("order_id IS NULL").count() == 1  # a null key equals no key
    assert {r["step"]: r["rows"] for r in counts.collect()} == {"new": 160, "updated": 720, "deleted": 361}
