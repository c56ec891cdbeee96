"""Readers and writers for tables, message streams and relational sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores.

    An input with at least one split per core is returned as it is, so this never
    shuffles a large table; it only helps files that Spark cannot split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key into as many tasks as the session has shuffle partitions.

    AQE does not merge these into fewer, nor those of a join's other side, so what a task sorts does not grow until a
    merged partition reaches its advisory size. Deal the side of a join that is shuffled anyway, or the smaller one: if
    that is broadcast, the other stays where it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None,
                   max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; ``max_files`` bounds each micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def text_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """One message per line, in column ``value``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None,
                   starting: str = "latest", options: Mapping[str, str] | None = None) -> DataFrame:
    """A topic's messages as text. Needs the Kafka connector jar on the class path."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.options(**(options or {})).load().select(F.col("value").cast("string").alias("value"))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None,
               partitions: int = 16, options: Mapping[str, str] | None = None) -> DataFrame:
    """A relational table, read in parallel key ranges when ``bounds`` are known. Needs a driver jar."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if key and bounds:
        reader = (reader.option("partitionColumn", key).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", partitions))
    return reader.load()


def day_partitions(spark: SparkSession, path: str, first_day=None, last_day=None) -> DataFrame:
    """A day-partitioned table; the bounds prune folders before anything is read."""
    df = spark.read.parquet(path)
    if first_day is not None:
        df = df.filter(F.col("event_date") >= first_day)
    if last_day is not None:
        df = df.filter(F.col("event_date") <= last_day)
    return df


def latest_per_key(versions: DataFrame, keys: Sequence[str], version: str = "batch_id") -> DataFrame:
    """The newest version of each key from a table of versioned partial results."""
    rest = [c for c in versions.columns if c not in (*keys, version)]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])
