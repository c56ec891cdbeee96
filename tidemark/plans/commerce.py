"""Registered e-commerce queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.fixed_values import FIRST_NAMES_EVEN, FIRST_NAMES_ODD, LAST_NAMES, PRODUCT_CATALOGUE
from tidemark.operators import commerce as E
from tidemark.plans.register import Registry
from tidemark.plans.views_sql import sql
from tidemark.session import cut_lineage, work_path
from tidemark.sources import testmodel as m
from tidemark.sources.kept import kept
from tidemark.streaming import jobs

register = Registry()
HOURS = 24 * 30


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@register("e1_hourly_revenue", sql("order_headers", f"""
SELECT *, revenue / order_count AS avg_order_value,
       (revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0) AS growth_rate
FROM (SELECT partner_id, date_trunc('hour', order_date) AS hour, CAST(sum(taxful_total_price) AS DOUBLE) AS revenue,
             count(*) AS order_count
      FROM order_headers WHERE order_date >= (SELECT max(order_date) FROM order_headers) - INTERVAL {HOURS} HOUR
      GROUP BY 1, 2)
WINDOW w AS (PARTITION BY partner_id ORDER BY hour)"""))
def e1(spark, sf):
    return E.hourly_revenue(m.order_headers(spark, sf), hours=HOURS)


_FUNNEL = """SELECT partner_id, count(*) FILTER (event_type = 'view') AS views,
  count(*) FILTER (event_type = 'cart') AS carts, count(*) FILTER (event_type = 'purchase') AS purchases
FROM clickstream WHERE event_time >= (SELECT max(event_time) FROM clickstream) - INTERVAL 7 DAY GROUP BY 1"""


@register("e2_conversion_funnel", sql("clickstream", _FUNNEL))
def e2(spark, sf):
    return E.conversion_funnel(m.clickstream(spark, sf))


@register("e3_funnel_rates", sql("clickstream", f"""
SELECT *, 30 AS period_days, CASE WHEN views > 0 THEN carts / views ELSE 0 END AS view_to_cart_rate,
       CASE WHEN carts > 0 THEN purchases / carts ELSE 0 END AS cart_to_purchase_rate FROM ({_FUNNEL})"""))
def e3(spark, sf):
    return E.funnel_rates(jobs.funnel_view(spark, _funnel(spark, sf)), days=30)


def _funnel(spark, sf):
    """The stored funnel, loaded with the clickstream as one batch."""
    def load():
        folder = work_path(spark, "funnel")
        jobs.add_to_funnel(m.clickstream(spark, sf), folder, 0)
        return folder
    return kept(spark, "funnel", f"{sf}/events.parquet", load)


def _recent(spark, sf, hours):
    """Orders of the last hours with their JSON columns, and the newest date of all: only their lines are shuffled and made to JSON."""
    headers = m.customer_orders(spark, sf)
    newest = headers.agg(F.max("order_date")).first()[0]
    recent = cut_lineage(headers.filter(F.col("order_date") >= times.ago(newest, hours, "hour")))
    return m.ecommerce(spark, sf, recent), newest


@register("e4_product_ranking", sql("ecommerce", """
, sold AS (SELECT partner_id, order_date, (SELECT max(order_date) FROM ecommerce) AS now,
    json_extract_string(products, '$[0].product_name') AS name, json_extract_string(products, '$[0].category') AS category,
    CAST(json_extract_string(products, '$[0].taxful_price') AS DECIMAL(12,2)) AS price FROM ecommerce),
cur AS (SELECT partner_id, name, category, CAST(sum(price) AS DOUBLE) AS revenue FROM sold
        WHERE order_date >= now - INTERVAL 90 DAY GROUP BY 1, 2, 3),
prev AS (SELECT partner_id, name, CAST(sum(price) AS DOUBLE) AS prev_revenue FROM sold
         WHERE order_date >= now - INTERVAL 180 DAY AND order_date < now - INTERVAL 90 DAY GROUP BY 1, 2),
ranked AS (SELECT cur.*, prev_revenue,
    dense_rank() OVER (PARTITION BY cur.partner_id ORDER BY revenue DESC NULLS LAST) AS current_rank,
    dense_rank() OVER (PARTITION BY cur.partner_id ORDER BY prev_revenue DESC NULLS LAST) AS prev_rank
  FROM cur LEFT JOIN prev ON cur.partner_id = prev.partner_id AND cur.name = prev.name)
SELECT partner_id, name, coalesce(category, 'Uncategorized') AS category, revenue, CAST(current_rank AS INTEGER) AS current_rank,
  prev_rank, prev_rank - current_rank AS rank_change,
  CASE WHEN prev_revenue > 0 THEN (revenue - prev_revenue) / prev_revenue ELSE 0 END AS growth_rate
FROM ranked WHERE current_rank <= 20"""))
def e4(spark, sf):
    orders, newest = _recent(spark, sf, 24 * 180)
    return E.product_ranking(orders, k=20, as_of=newest, days=90)


@register("e5_summary_stats", sql("order_headers", f"""
SELECT p.partner_id, coalesce(n, 0) AS total_orders, coalesce(r, 0) AS total_revenue, coalesce(r / n, 0) AS avg_order_value
FROM (SELECT DISTINCT partner_id FROM order_headers) p LEFT JOIN (
  SELECT partner_id, count(*) AS n, CAST(sum(taxful_total_price) AS DOUBLE) AS r FROM order_headers
  WHERE order_date >= (SELECT max(order_date) FROM order_headers) - INTERVAL {HOURS} HOUR GROUP BY 1) s
ON p.partner_id = s.partner_id"""))
def e5(spark, sf):
    orders = m.order_headers(spark, sf)
    return E.summary_stats(orders, hours=HOURS, partners=orders)


@register("e6_hourly_breakdown", sql("order_headers", f"""
SELECT partner_id, strftime(h, '%Y-%m-%dT%H:00:00Z') AS hour, revenue, orders FROM (
  SELECT * FROM (
    SELECT partner_id, date_trunc('hour', order_date) AS h, CAST(sum(taxful_total_price) AS DOUBLE) AS revenue, count(*) AS orders
    FROM order_headers WHERE order_date >= (SELECT max(order_date) FROM order_headers) - INTERVAL {HOURS} HOUR
    GROUP BY 1, 2))"""))
def e6(spark, sf):
    return E.hourly_breakdown(m.order_headers(spark, sf), hours=HOURS)


@register("e7_top_categories", sql("ecommerce", f"""
SELECT partner_id, category, revenue, orders FROM (
  SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY revenue DESC, category) AS rn FROM (
    SELECT partner_id, category, CAST(sum(taxful_total_price) AS DOUBLE) AS revenue, count(*) AS orders FROM (
      SELECT partner_id, taxful_total_price, unnest(from_json(category, '["VARCHAR"]')) AS category FROM ecommerce
      WHERE order_date >= (SELECT max(order_date) FROM ecommerce) - INTERVAL {HOURS} HOUR)
    GROUP BY 1, 2)) WHERE rn <= 10"""))
def e7(spark, sf):
    orders, newest = _recent(spark, sf, HOURS)
    return E.top_categories(orders, hours=HOURS, as_of=newest)


@register("e8_events_per_minute", sql("clickstream", """
SELECT partner_id, date_trunc('minute', event_time) AS minute_start, strftime(date_trunc('minute', event_time), '%H:%M') AS minute,
  count(*) AS count FROM clickstream
WHERE event_time >= (SELECT max(event_time) FROM clickstream) - INTERVAL 2880 MINUTE GROUP BY 1, 2, 3"""))
def e8(spark, sf):
    return E.events_per_minute(m.clickstream(spark, sf), minutes=2880)


@register("e9_revenue_per_minute", sql("order_headers", """
SELECT partner_id, strftime(order_date, '%H:%M') AS minute, CAST(sum(taxful_total_price) AS DOUBLE) AS revenue, count(*) AS orders
FROM order_headers WHERE order_date >= (SELECT max(order_date) FROM order_headers) - INTERVAL 43200 MINUTE GROUP BY 1, 2"""))
def e9(spark, sf):
    return E.revenue_per_minute(m.order_headers(spark, sf), minutes=43200)


_ORDER_COLUMNS = """partner_id, order_id, order_date, customer_id, coalesce(customer_first_name, '') AS customer_first_name,
  coalesce(customer_last_name, '') AS customer_last_name, coalesce(customer_full_name, '') AS customer_full_name,
  coalesce(customer_gender, '') AS customer_gender, coalesce(email, '') AS email, coalesce(currency, 'USD') AS currency,
  CAST(taxful_total_price AS DOUBLE) AS taxful_total_price, coalesce(CAST(taxless_total_price AS DOUBLE), 0) AS taxless_total_price,
  coalesce(total_quantity, 0) AS total_quantity, coalesce(total_unique_products, 0) AS total_unique_products, order_status,
  coalesce(category, '[]') AS category, coalesce(manufacturer, '[]') AS manufacturer, coalesce(products, '[]') AS products,
  coalesce(geoip, '{}') AS geoip"""


@register("e10_recent_orders", sql("ecommerce", f"""
SELECT {_ORDER_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY order_date DESC, order_id DESC) AS rn FROM ecommerce)
WHERE rn <= 20"""))
def e10(spark, sf):
    headers = m.customer_orders(spark, sf)
    newest = cut_lineage(E.newest_keys(headers, 20).select("order_id"))
    # At most 20 keys a partner, so they go to the orders and lines, not these to them.
    wanted = cut_lineage(headers.join(F.broadcast(newest), "order_id", "left_semi"))
    return E.recent_orders(m.ecommerce(spark, sf, F.broadcast(wanted)), limit=20)


@register("e11_recent_clickstream", sql("clickstream", """
SELECT partner_id, event_id, event_type, user_id, '{"product_name":"' || coalesce(product_name, '') || '","category":"'
  || coalesce(product_category, '') || '","price":' || coalesce(CAST(product_price AS VARCHAR), '0') || '}' AS event_properties,
  strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY event_time DESC, event_id DESC) AS rn FROM clickstream)
WHERE rn <= 50"""))
def e11(spark, sf):
    return E.recent_clickstream(m.clickstream(spark, sf))


@register("e12_json_columns", sql("ecommerce", """
SELECT order_id, coalesce(category, '[]') AS category_json, coalesce(manufacturer, '[]') AS manufacturer_json,
  coalesce(json_array_length(products), 0) AS n_products, CASE WHEN json_valid(geoip) THEN geoip ELSE '{}' END AS geoip_json
FROM ecommerce"""))
def e12(spark, sf):
    parsed = E.parse_json_columns(m.ecommerce(spark, sf))
    return parsed.select(
        "order_id", F.to_json("category_json").alias("category_json"),
        F.to_json("manufacturer_json").alias("manufacturer_json"),
        F.json_array_length(F.to_json("products_json")).cast("long").alias("n_products"),
        F.to_json("geoip_json").alias("geoip_json"))


@register("e13_lookup_orders", """
SELECT order_id, found_date AS order_date, found_date IS NOT NULL AS found FROM (
  SELECT DISTINCT c_custkey AS order_id FROM customer) LEFT JOIN (
  SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS found_date FROM orders
  WHERE o_orderstatus <> 'P') ON order_id = o_orderkey""")
def e13(spark, sf):
    wanted = m.table(spark, sf, "customer").select(F.col("c_custkey").alias("order_id"))
    return E.lookup_orders(wanted, m.order_headers(spark, sf).filter("order_status <> 'processing'"))


@register("e14_verify_sync", sql("order_headers", """
SELECT order_id, has_lines AS synced, CAST(CASE WHEN NOT has_lines THEN 0 WHEN order_id % 5000 < 1000 THEN 250
  ELSE order_id % 5000 - 1000 END AS BIGINT) AS latency_ms
FROM (SELECT order_id, order_id IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM order_headers)"""))
def e14(spark, sf):
    source = m.order_headers(spark, sf)
    shipped = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    shift = (F.col("order_id") % 5000 - 1000).cast("int")
    target = (source.join(shipped, "order_id", "left_semi")
              .withColumn("order_date", F.timestamp_add("MILLISECOND", shift, F.col("order_date"))))
    return E.verify_sync(source, target, waited_ms=250)


def _legacy_orders(spark, sf):
    return m.order_headers(spark, sf).select(
        "partner_id", "order_id", F.col("customer_id").alias("user_id"),
        F.col("taxful_total_price").cast("double").alias("total_amount"), "order_status", "order_date")


def _legacy_items(spark, sf):
    return m.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"))


@register("e15_recent_legacy_orders", sql("order_headers", f"""
SELECT partner_id, order_id, customer_id AS user_id,
  CASE WHEN customer_id % 2 = 0 THEN {_sql_list(FIRST_NAMES_EVEN)}[customer_id % 16 + 1]
       ELSE {_sql_list(FIRST_NAMES_ODD)}[customer_id % 16 + 1] END || ' ' || {_sql_list(LAST_NAMES)}[(customer_id // 2) % 16 + 1]
  AS customer_name, CAST(taxful_total_price AS DOUBLE) AS total_amount, order_status, order_date
FROM (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY order_date DESC, order_id DESC) AS rn FROM order_headers)
WHERE rn <= 100"""))
def e15(spark, sf):
    return E.recent_legacy_orders(_legacy_orders(spark, sf), limit=100)


@register("e16_catalogue_lookup", f"""
SELECT p_partkey, {_sql_list(n for _, n in PRODUCT_CATALOGUE)}[p_partkey % {len(PRODUCT_CATALOGUE)} + 1] AS catalogue_name,
  {_sql_list(c for c, _ in PRODUCT_CATALOGUE)}[p_partkey % {len(PRODUCT_CATALOGUE)} + 1] AS catalogue_category FROM part""")
def e16(spark, sf):
    return E.catalogue_lookup(m.table(spark, sf, "part").select("p_partkey"), "p_partkey")


@register("e17_order_total", """
SELECT l_orderkey AS order_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS INTEGER)) AS DOUBLE) AS total_amount,
  count(*) AS lines FROM lineitem GROUP BY 1""")
def e17(spark, sf):
    return E.order_total(_legacy_items(spark, sf))


@register("e18_orders_with_items", sql("order_headers", """
SELECT order_id, order_status, 0 AS page, coalesce(n, 0) AS n_items, coalesce(items, '') AS items
FROM order_headers LEFT JOIN (
  SELECT l_orderkey, sum(copies) AS n, string_agg(l_linenumber || ':' || l_partkey || ':' || q || ':' || p || 'x' || copies, ','
           ORDER BY l_linenumber, l_partkey, q, p) AS items
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS p, count(*) AS copies FROM lineitem GROUP BY ALL)
  GROUP BY 1) ON order_id = l_orderkey""").replace("sum(copies) AS n", "CAST(sum(copies) AS BIGINT) AS n"))
def e18(spark, sf):
    nested = E.orders_with_items(_legacy_orders(spark, sf), _legacy_items(spark, sf))
    shown = F.transform("items", lambda i: F.concat_ws(
        ":", i["line_no"].cast("string"), i["product_id"].cast("string"), i["quantity"].cast("string"),
        F.concat(i["unit_price"].cast("string"), F.lit("x"), i["copies"].cast("string"))))
    return nested.select("order_id", "order_status", "page",
                         F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["copies"]).alias("n_items"),
                         F.array_join(shown, ",").alias("items"))


@register("e19_with_dimension", """
SELECT c_custkey, c_nationkey AS nation_key, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def e19(spark, sf):
    facts = m.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation_key"))
    dim = m.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_key"), "n_name")
    return E.with_dimension(facts, dim, "nation_key")


@register("e20_data_age", sql("order_headers", """
SELECT 'orders' AS table_name, count(*) AS total_rows, count(*) FILTER (order_date >= now - INTERVAL 1 DAY) AS last_1_day,
  count(*) FILTER (order_date >= now - INTERVAL 3 DAY) AS last_3_days, count(*) FILTER (order_date >= now - INTERVAL 7 DAY) AS last_7_days,
  count(*) FILTER (order_date < now - INTERVAL 3 DAY) AS older_than_3_days, min(order_date) AS oldest_record, max(order_date) AS newest_record
FROM order_headers, (SELECT max(order_date) AS now FROM order_headers)"""))
def e20(spark, sf):
    return E.data_age(m.order_headers(spark, sf), "order_date", "orders")


def _status_updates(spark, sf):
    """One request per customer key, some for unknown orders, some with a bad status."""
    key = F.col("c_custkey")
    return m.table(spark, sf, "customer").select(
        (key * 17).alias("order_id"),
        F.when(key % 3 == 0, "shipped").when(key % 3 == 1, "cancelled").otherwise("lost").alias("new_status"))


_STATUS_SQL = """SELECT u.order_id, new_status, old_status, CASE WHEN new_status = 'lost' THEN 'invalid_status'
  WHEN old_status IS NULL THEN 'not_found' ELSE 'updated' END AS outcome
FROM (SELECT c_custkey * 17 AS order_id, CASE c_custkey % 3 WHEN 0 THEN 'shipped' WHEN 1 THEN 'cancelled' ELSE 'lost' END AS new_status
      FROM customer) u LEFT JOIN (SELECT order_id, order_status AS old_status FROM order_headers) o ON u.order_id = o.order_id"""


@register("e21_set_status", sql("order_headers", _STATUS_SQL))
def e21(spark, sf):
    return E.set_status(m.order_headers(spark, sf), _status_updates(spark, sf))


@register("e21_apply_status", sql("order_headers", f"""
SELECT o.order_id, CASE WHEN outcome = 'updated' THEN new_status ELSE order_status END AS order_status
FROM order_headers o LEFT JOIN ({_STATUS_SQL}) s ON o.order_id = s.order_id"""))
def e21_apply(spark, sf):
    orders = m.order_headers(spark, sf).select("order_id", "order_status")
    return E.apply_status(orders, E.set_status(orders, _status_updates(spark, sf)))


@register("e21_repeated_requests", sql("order_headers", """
SELECT o.order_id, CASE WHEN o.order_id % 34 = 0 THEN 'shipped' WHEN o.order_id % 17 = 0 THEN 'cancelled' ELSE order_status END AS order_status,
  CASE WHEN o.order_id % 17 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE updated_at END AS updated_at FROM order_headers o"""))
def e21_repeated(spark, sf):
    """Every seventeenth order is cancelled, then each second one of these shipped after all."""
    orders = m.order_headers(spark, sf).select("order_id", "order_status", "updated_at")
    ids = orders.filter("order_id % 17 = 0").select("order_id")
    asked = ids.withColumn("new_status", F.lit("cancelled")).withColumn("request", F.lit(1)).unionByName(
        ids.filter("order_id % 34 = 0").withColumn("new_status", F.lit("shipped")).withColumn("request", F.lit(2)))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return E.apply_status(orders, E.set_status(orders, asked), version="request", now=now)


@register("e22_delete_keys", """
SELECT 'header' AS part, count(*) AS rows FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey * 17 FROM customer)
UNION ALL SELECT 'line', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT c_custkey * 17 FROM customer)""")
def e22(spark, sf):
    gone = _status_updates(spark, sf).select("order_id")
    left = [E.delete_keys(df, gone, "order_id").agg(F.lit(part).alias("part"), F.count("*").alias("rows"))
            for part, df in (("header", _legacy_orders(spark, sf)), ("line", _legacy_items(spark, sf)))]
    return left[0].unionByName(left[1])


@register("e23_range_or_tenant", sql("clickstream", """
SELECT event_id, user_id, partner_id FROM clickstream WHERE user_id BETWEEN 4400 AND 5399 OR partner_id = 44"""))
def e23(spark, sf):
    return E.range_or_tenant(m.clickstream(spark, sf), 44).select("event_id", "user_id", "partner_id")


@register("e24_rolling_sum", sql("order_headers", """
SELECT *, CAST(sum(cents) OVER (PARTITION BY partner_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling
FROM (SELECT partner_id, date_trunc('hour', order_date) AS hour, CAST(sum(taxful_total_price) * 100 AS BIGINT) AS cents
      FROM order_headers GROUP BY 1, 2)"""))
def e24(spark, sf):
    hour = E.times.floor_time("order_date", 1, "hour").alias("hour")
    hourly = (m.order_headers(spark, sf).groupBy("partner_id", hour)
              .agg((F.sum("taxful_total_price") * 100).cast("long").alias("cents")))
    return E.rolling_sum(hourly, ["partner_id"], "hour", "cents")


@register("e25_percentile", sql("order_headers", """
SELECT partner_id, round(quantile_cont(CAST(taxful_total_price AS DOUBLE), 0.95), 6) AS percentile FROM order_headers
WHERE order_status = 'delivered' GROUP BY 1"""))
def e25(spark, sf):
    closed = m.order_headers(spark, sf).filter("order_status = 'delivered'").withColumn(
        "price", F.col("taxful_total_price").cast("double"))
    # The two engines interpolate with different operation orders.
    return E.percentile(closed, "price", 0.95, ["partner_id"]).withColumn("percentile", F.round("percentile", 6))


@register("e26_funnel_share", sql("clickstream", """
SELECT event_type, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM clickstream WHERE event_type = 'view') AS pct
FROM clickstream GROUP BY 1"""))
def e26(spark, sf):
    return E.funnel_share(m.clickstream(spark, sf))


@register("e27_latency_sla", sql("bench_events", """
SELECT count(*) AS samples, count(*) FILTER (lat > 500) AS breaches, CAST(round(avg(lat)) AS BIGINT) AS mean_ms
FROM (SELECT event_id % 1000 + 200 AS lat FROM bench_events)"""))
def e27(spark, sf):
    created = F.to_timestamp_ntz("event_timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    samples = m.bench_events(spark, sf).select(
        E.times.millis_between(F.date_trunc("millisecond", created).cast("timestamp_ntz"), "ingest_time").alias("latency_ms"))
    return E.latency_sla(samples)


@register("e28_changelog_summary", sql("order_headers", """
SELECT count(*) AS operations, count(*) FILTER (has) AS timed, avg(lat) FILTER (has) AS mean_latency_ms FROM (
  SELECT order_id IN (SELECT l_orderkey FROM lineitem) AS has,
         CASE WHEN order_id % 5000 < 1000 THEN 250 ELSE order_id % 5000 - 1000 END AS lat FROM order_headers)"""))
def e28(spark, sf):
    changes = e14(spark, sf).select(F.when(F.col("synced"), F.col("latency_ms")).alias("latency_ms"))
    return E.changelog_summary(changes)
