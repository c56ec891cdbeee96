"""Stand-ins: the engine's data model derived by Spark from the benchmark tables.

Each adapter scans whole tables with only the columns it needs and keeps every
row. ``FIXTURES.md`` part B describes the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.text import entity_words
from tidemark.sources.readers import spread

CHUNK_CHARS = 400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_products(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """Per order: product and brand lists as JSON, item totals; ``only`` names the orders wanted.

    Lines are first combined per (order, product type), so the lists below are
    bounded by the type and brand vocabularies, however many lines an order has.
    They are dealt by order once, which serves both groupings and the join of the orders.
    """
    line = spread(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    if only is not None:
        line = line.join(only.select(F.col("order_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    joined = line.join(part, line.l_partkey == part.p_partkey).drop("p_partkey").repartition("l_orderkey")
    first_line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name")
    per_type = joined.groupBy("l_orderkey", "p_type").agg(
        F.min(first_line).alias("place"),
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(12,2)").alias("taxful_price"),
        F.sum("l_quantity").cast("int").alias("quantity"),
        F.collect_set("p_brand").alias("brands"))
    entry = F.struct("place", F.col("place.p_name").alias("product_name"), F.col("p_type").alias("category"), "taxful_price")
    return per_type.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("brands")))).alias("brands"),
        F.sum("quantity").cast("int").alias("total_quantity"),
        F.sum("taxful_price").cast("decimal(12,2)").alias("taxless_total_price"),
    ).select(
        "l_orderkey", "total_quantity", "taxless_total_price",
        F.size("entries").alias("total_unique_products"),
        F.to_json(F.transform("entries", lambda e: F.struct(
            e["product_name"].alias("product_name"), e["category"].alias("category"),
            e["taxful_price"].alias("taxful_price")))).alias("products"),
        F.to_json(F.array_sort(F.transform("entries", lambda e: e["category"]))).alias("category"),
        F.to_json("brands").alias("manufacturer"))


def order_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Order columns that need no line items: key, tenant, time, money, status."""
    o = table(spark, sf, "orders")
    seconds = (F.col("o_orderkey") * 7919 % 86400).cast("int")
    order_date = F.timestamp_add("SECOND", seconds, F.col("o_orderdate"))
    hours = (F.col("o_orderkey") % 3).cast("int")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_custkey") % 3 + 44).cast("int").alias("partner_id"),
        order_date.alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("taxful_total_price"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("processing").alias("order_status"),
        order_date.alias("created_at"),
        F.timestamp_add("HOUR", hours, order_date).alias("updated_at"))


def customer_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The headers of the orders that ``ecommerce`` holds: those of a known customer."""
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    return order_headers(spark, sf).join(known, "customer_id", "left_semi")


def ecommerce(spark: SparkSession, sf: str, headers: DataFrame | None = None) -> DataFrame:
    """Full order rows, including customer attributes and the JSON columns, of all orders or of the given headers."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    geo = F.concat(F.lit('{"country_iso_code":"N'), F.col("c_nationkey").cast("string"), F.lit('"'),
                   F.when(F.col("c_acctbal") < 0, "").otherwise("}"))
    products = order_products(spark, sf, headers)
    return ((order_headers(spark, sf) if headers is None else headers)
            .join(c, F.col("customer_id") == c.c_custkey)
            .join(products, F.col("order_id") == products.l_orderkey, "left")
            .select(
                "order_id", "partner_id", "order_date", "customer_id",
                F.split_part("c_name", F.lit("#"), F.lit(1)).alias("customer_first_name"),
                F.split_part("c_name", F.lit("#"), F.lit(2)).alias("customer_last_name"),
                F.col("c_name").alias("customer_full_name"),
                F.when(F.col("c_custkey") % 3 == 1, "F").when(F.col("c_custkey") % 3 == 2, "M").alias("customer_gender"),
                F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                F.when(F.col("c_nationkey") % 2 == 0, "EUR").alias("currency"),
                "taxful_total_price", "taxless_total_price", "total_quantity", "total_unique_products",
                "order_status", "category", "manufacturer", "products", geo.alias("geoip"),
                "created_at", "updated_at"))


def clickstream(spark: SparkSession, sf: str) -> DataFrame:
    return clickstream_from_events(table(spark, sf, "events"))


def clickstream_from_events(events: DataFrame) -> DataFrame:
    """Works on the batch table and on a stream of the same rows."""
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("event_time"),
        (F.col("user_id") % 3 + 44).cast("int").alias("partner_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        "user_id",
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 20).cast("string")).alias("page_url"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("product-"), (F.col("user_id") % 50).cast("string")))
        .alias("product_name"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("cat-"), (F.col("user_id") % 7).cast("string")))
        .alias("product_category"),
        F.when(F.col("event_type") != "view", F.col("value")).cast("decimal(10,2)").alias("product_price"))


def clickstream_json(spark: SparkSession, sf: str) -> DataFrame:
    return clickstream_json_from_events(spread(table(spark, sf, "events")))


def clickstream_json_from_events(events: DataFrame) -> DataFrame:
    """One JSON message per event in the wire shape; some are cut short and malformed.

    Sign-ups carry the price as text, which the ingest must not read as a number.
    """
    price = F.col("value").cast("decimal(10,2)").cast("string")
    price = F.when(F.col("event_type") == "signup", F.concat(F.lit('"'), price, F.lit('"'))).otherwise(price)
    message = F.concat(
        F.lit('{"event_id":"'), F.col("event_id").cast("string"),
        F.lit('","session_id":"'), F.col("user_id").cast("string"),
        F.lit('","partner_id":'), (F.col("user_id") % 3 + 44).cast("string"),
        F.lit(',"user_id":'), F.col("user_id").cast("string"),
        F.lit(',"event_type":"'), F.col("event_type"),
        F.lit('","event_timestamp":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit('","page_url":"/p/'), (F.col("user_id") % 20).cast("string"),
        F.lit('","device_info":{"type":"'),
        F.when(F.col("user_id") % 2 == 0, "mobile").otherwise("desktop"),
        F.when(F.col("user_id") % 5 == 0, F.lit('"}')).otherwise(F.lit('","os":"os-a"}')),
        F.lit(',"event_properties":{"product_name":"product-'), (F.col("user_id") % 50).cast("string"),
        F.lit('","category":"cat-'), (F.col("user_id") % 7).cast("string"),
        F.lit('","price":'), price, F.lit('},"utm_params":{"source":"mail"}}'))
    cut = F.col("event_id") % 97 == 0
    return events.select(
        F.when(cut, F.substring(message, 1, 60)).otherwise(message).alias("value"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans_from_events(table(spark, sf, "events"))


def spans_from_events(events: DataFrame) -> DataFrame:
    trace = F.floor(F.col("event_id") / 8).cast("long")
    step = F.col("event_id") % 8
    parent = trace * 8 + F.floor((step - 1) / 2)
    micros = (F.col("value") * 1000).cast("long")
    return events.select(
        trace.cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.when(step != 0, parent.cast("string")).alias("parent_span_id"),
        F.col("event_type").alias("span_name"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
        F.create_map(F.lit("host"), F.concat(F.lit("host-"), (F.col("user_id") % 4).cast("string")))
        .alias("resource_attributes"),
        F.col("ts").alias("timestamp"),
        F.timestamp_add("MICROSECOND", micros, F.col("ts")).alias("end_time"),
        micros.alias("duration"),
        F.from_json("props", "map<string,string>").alias("span_attributes"),
        F.when(step == 0, "SPAN_KIND_SERVER").otherwise("SPAN_KIND_CLIENT").alias("span_kind"),
        F.when(F.col("event_type") == "error", "STATUS_CODE_ERROR")
        .when(F.col("event_type") == "purchase", "STATUS_CODE_OK")
        .otherwise("STATUS_CODE_UNSET").alias("status_code"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """One log line per event; the body is the whole text of a document."""
    documents = table(spark, sf, "documents")
    n_docs = documents.agg(F.count("*")).scalar()
    docs = spread(documents.select("doc_id", F.col("text").alias("body")))
    events = table(spark, sf, "events").withColumn("doc_key", F.col("event_id") % n_docs)
    return events.join(docs, F.col("doc_key") == F.col("doc_id")).select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN")
        .otherwise("INFO").alias("severity_text"),
        F.floor(F.col("event_id") / 8).cast("string").alias("trace_id"),
        F.col("props").alias("attributes"),
        F.col("value").alias("duration"),
        "body")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_from_documents(spread(table(spark, sf, "documents")))


def chunks_from_documents(documents: DataFrame) -> DataFrame:
    """Documents cut into windows of 400 characters, with entities and triples."""
    # One pass cuts the whole text; an explode of positions would copy the text, and search it from its start, for each chunk.
    windows = F.when(F.length("text") > CHUNK_CHARS, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0)))
    kind = F.col("doc_id") % 10
    cut = documents.select(
        F.col("source").alias("tenant_id"), F.col("lang").alias("corpus_id"),
        F.col("doc_id").alias("doc_key"),
        F.when(kind == 8, "image").when(kind == 9, "table").otherwise("text").alias("content_type"),
        F.posexplode(F.coalesce(windows, F.array("text"))).alias("chunk_index", "content"))
    names = F.transform(entity_words("content"), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", ""))
    named = cut.withColumn("entity_names", names)
    pairs = F.zip_with(
        F.slice("entity_names", 1, F.greatest(F.size("entity_names") - 1, F.lit(0))),
        F.slice("entity_names", 2, F.greatest(F.size("entity_names") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("source"), F.lit("NEXT").alias("relation"), b.alias("target")))
    return named.select(
        "tenant_id", "corpus_id",
        F.concat_ws("-", F.col("doc_key").cast("string"), F.col("chunk_index").cast("string")).alias("row_id"),
        "content_type", "content", "entity_names", F.to_json(pairs).alias("relationships"),
        F.col("doc_key").cast("string").alias("doc_id"), "chunk_index",
        (F.floor(F.col("chunk_index") / 4) + 1).cast("int").alias("page_number"), "doc_key")


def embedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the vector of their document."""
    vecs = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("content_embedding"))
    n = vecs.agg(F.count("*")).scalar()
    keyed = chunks(spark, sf).withColumn("vec_key", F.col("doc_key") % n)
    return keyed.join(vecs, F.col("vec_key") == F.col("vec_id")).drop("vec_key", "vec_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One real vector per label: the query set of the retrieval jobs."""
    return vectors(spark, sf).groupBy(F.col("label").cast("string").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("vector"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with citation marks appended, one of them an image reference."""
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn",
        F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("] ![fig][IMG-"),
                 F.col("conv_id").cast("string"), F.lit("] [TABLE-"), F.col("turn").cast("string"),
                 F.lit("] [EQ-x]")).alias("text"))


def bench_events(spark: SparkSession, sf: str) -> DataFrame:
    return bench_events_from_events(table(spark, sf, "events"))


def bench_events_from_events(e: DataFrame) -> DataFrame:
    """Events with their creation time as text and a load time in milliseconds."""
    delay = (F.col("event_id") % 1000 + 200).cast("int")
    loaded = F.date_trunc("millisecond", F.timestamp_add("MILLISECOND", delay, F.col("ts"))).cast("timestamp_ntz")
    return e.select(
        "event_id", (F.col("user_id") % 3 + 44).cast("int").alias("partner_id"), "event_type",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_timestamp"),
        loaded.alias("ingest_time"), F.length("props").alias("payload_bytes"))
