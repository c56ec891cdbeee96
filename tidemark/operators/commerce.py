"""E-commerce reports: revenue, funnels, rankings, lookups, order maintenance.

Order inputs carry ``order_id, partner_id, order_date, taxful_total_price`` and
the JSON columns of the order model. Every report covers all partners at once;
filter on ``partner_id`` first for a single tenant. ``as_of`` replaces the wall
clock and defaults to the newest timestamp of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import times
from tidemark.functions.fixed_values import (
    FIRST_NAMES_EVEN, FIRST_NAMES_ODD, FUNNEL_LABELS, LAST_NAMES, ORDER_STATUSES, PRODUCT_CATALOGUE,
)
from tidemark.functions.scale import (
    collect_in_pages, exact_percentiles, top_per_group, with_dense_rank,
)
from tidemark.session import cut_lineage

MONEY = "decimal(12,2)"


def _since(df: DataFrame, ts: str, n: int, unit: str, as_of=None) -> DataFrame:
    return df.filter(F.col(ts) >= times.ago(times.as_of(df, ts, as_of), n, unit))


def _revenue() -> Column:
    return F.sum("taxful_total_price").cast("double")


def hourly_revenue(orders: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """Revenue per hour and its growth over the previous hour that has orders."""
    hourly = (_since(orders, "order_date", hours, "hour", as_of)
              .groupBy("partner_id", times.floor_time("order_date", 1, "hour").alias("hour"))
              .agg(_revenue().alias("revenue"), F.count("*").alias("order_count")))
    previous = F.lag("revenue").over(Window.partitionBy("partner_id").orderBy("hour"))
    return (hourly.withColumn("_prev", previous)
            .select("partner_id", "hour", "revenue", "order_count",
                    (F.col("revenue") / F.col("order_count")).alias("avg_order_value"),
                    ((F.col("revenue") - F.col("_prev")) / F.nullif(F.col("_prev"), F.lit(0.0))).alias("growth_rate"))
            .orderBy("partner_id", F.desc("hour")))


def conversion_funnel(clicks: DataFrame, as_of=None, days: int = 7,
                      labels: Sequence[str] = FUNNEL_LABELS) -> DataFrame:
    """Views, carts and purchases per partner over the trailing days."""
    counts = [F.count_if(F.col("event_type") == label).alias(name)
              for label, name in zip(labels, ("views", "carts", "purchases"))]
    return _since(clicks, "event_time", days, "day", as_of).groupBy("partner_id").agg(*counts)


def funnel_rates(funnel: DataFrame, days: int = 7) -> DataFrame:
    """Step-to-step rates of a funnel; ``days`` only labels the row."""
    def rate(num: str, den: str) -> Column:
        return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(0.0)
    return funnel.select(
        "partner_id", F.lit(days).alias("period_days"), "views", "carts", "purchases",
        rate("carts", "views").alias("view_to_cart_rate"),
        rate("purchases", "carts").alias("cart_to_purchase_rate"))


def product_ranking(orders: DataFrame, k: int = 20, as_of=None, days: int = 7) -> DataFrame:
    """First-product revenue of this period ranked against the period before.

    The current side is grouped by (name, category), the previous one by name
    only, so a name in two categories meets the same previous revenue twice.
    The per-product sums are stored once, as the two rankings read them repeatedly.
    """
    now = times.as_of(orders, "order_date", as_of)
    split, start = times.ago(now, days, "day"), times.ago(now, 2 * days, "day")
    sold = orders.filter(F.col("order_date") >= start).select(
        "partner_id", (F.col("order_date") >= split).alias("_now"),
        F.get_json_object("products", "$[0].product_name").alias("product_name"),
        F.get_json_object("products", "$[0].category").alias("category"),
        F.get_json_object("products", "$[0].taxful_price").try_cast(MONEY).alias("_price"))
    # One pass over the orders; the previous side is then added up by name only.
    sides = sold.groupBy("partner_id", "product_name", "category").agg(
        F.count_if("_now").alias("_orders"),
        F.sum(F.when(F.col("_now"), F.col("_price"))).cast("double").alias("revenue"),
        F.sum(F.when(~F.col("_now"), F.col("_price"))).alias("_before"))
    by_name = Window.partitionBy("partner_id", "product_name")
    named = F.when(F.col("product_name").isNotNull(), F.sum("_before").over(by_name)).cast("double")
    both = cut_lineage(sides.withColumn("prev_revenue", named).filter("_orders > 0").drop("_orders", "_before"))
    ranked = with_dense_rank(both, "partner_id", "prev_revenue", "prev_rank")
    by_revenue = Window.partitionBy("partner_id").orderBy(F.desc_nulls_last("revenue"))
    kept = ranked.withColumn("current_rank", F.dense_rank().over(by_revenue)).filter(F.col("current_rank") <= k)
    growth = F.when(F.col("prev_revenue") > 0,
                    (F.col("revenue") - F.col("prev_revenue")) / F.col("prev_revenue")).otherwise(0.0)
    return (kept.select("partner_id", F.col("product_name").alias("name"),
                        F.coalesce("category", F.lit("Uncategorized")).alias("category"), "revenue",
                        "current_rank", "prev_rank",
                        (F.col("prev_rank") - F.col("current_rank")).alias("rank_change"),
                        growth.alias("growth_rate"))
            .orderBy("partner_id", "current_rank", "name"))


def summary_stats(orders: DataFrame, hours: int = 24, as_of=None, partners: DataFrame | None = None) -> DataFrame:
    """Order count, revenue and mean value of the trailing hours.

    With ``partners`` (one ``partner_id`` per row) quiet partners appear with zeros.
    """
    stats = (_since(orders, "order_date", hours, "hour", as_of).groupBy("partner_id")
             .agg(F.count("*").alias("total_orders"), _revenue().alias("total_revenue")))
    if partners is not None:
        stats = partners.select("partner_id").distinct().join(stats, "partner_id", "left")
    orders_n = F.coalesce("total_orders", F.lit(0))
    revenue = F.coalesce("total_revenue", F.lit(0.0))
    return stats.select(
        "partner_id", orders_n.alias("total_orders"), revenue.alias("total_revenue"),
        F.coalesce(revenue / F.nullif(orders_n, F.lit(0)), F.lit(0.0)).alias("avg_order_value"))


def hourly_breakdown(orders: DataFrame, hours: int = 24, as_of=None, max_buckets: int | None = None) -> DataFrame:
    """Revenue and orders per hour with an ISO label, newest first; ``max_buckets`` keeps only the newest ones."""
    hourly = (_since(orders, "order_date", hours, "hour", as_of)
              .groupBy("partner_id", times.floor_time("order_date", 1, "hour").alias("_hour"))
              .agg(F.coalesce(_revenue(), F.lit(0.0)).alias("revenue"), F.count("*").alias("orders")))
    if max_buckets:
        hourly = top_per_group(hourly, "partner_id", [F.desc("_hour")], max_buckets, ["_hour"], salts=1)
    return (hourly.select("partner_id", F.date_format("_hour", "yyyy-MM-dd'T'HH:00:00'Z'").alias("hour"),
                          "revenue", "orders")
            .orderBy("partner_id", F.desc("hour")))


def top_categories(orders: DataFrame, hours: int = 24, k: int = 10, as_of=None) -> DataFrame:
    """Each order counts fully for every entry of its JSON category list."""
    exploded = (_since(orders, "order_date", hours, "hour", as_of)
                .select("partner_id", "taxful_total_price",
                        F.explode(F.from_json("category", "array<string>")).alias("category")))
    sums = exploded.groupBy("partner_id", "category").agg(
        _revenue().alias("revenue"), F.count("*").alias("orders"))
    return top_per_group(sums, "partner_id", [F.desc("revenue"), F.asc("category")], k, ["category"])


def events_per_minute(clicks: DataFrame, minutes: int = 30, as_of=None) -> DataFrame:
    """Counts per full minute; the label shows only the time of day."""
    per_minute = (_since(clicks, "event_time", minutes, "minute", as_of)
                  .groupBy("partner_id", times.floor_time("event_time", 1, "minute").alias("minute_start"))
                  .agg(F.count("*").alias("count")))
    return (per_minute.select("partner_id", "minute_start", F.date_format("minute_start", "HH:mm").alias("minute"), "count")
            .orderBy("partner_id", "minute_start"))


def revenue_per_minute(orders: DataFrame, minutes: int = 30, as_of=None) -> DataFrame:
    """Revenue by HH:MM label, so one minute of several days is added up."""
    return (_since(orders, "order_date", minutes, "minute", as_of)
            .groupBy("partner_id", F.date_format("order_date", "HH:mm").alias("minute"))
            .agg(F.coalesce(_revenue(), F.lit(0.0)).alias("revenue"), F.count("*").alias("orders"))
            .orderBy("partner_id", "minute"))


def _positive(limit: int) -> None:
    if limit < 1:
        raise ValueError("limit must be positive")


def newest_keys(orders: DataFrame, limit: int) -> DataFrame:
    """Keys of the newest orders of each partner, ranked on narrow rows before wide ones are built or read."""
    _positive(limit)
    narrow = orders.select("partner_id", "order_date", "order_id")
    return top_per_group(narrow, "partner_id", [F.desc("order_date"), F.desc("order_id")], limit, ["order_id"])


def recent_orders(orders: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ``limit`` orders of each partner with per-column defaults for nulls."""
    _positive(limit)
    newest = top_per_group(orders, "partner_id", [F.desc("order_date"), F.desc("order_id")], limit, ["order_id"])
    text = ["customer_first_name", "customer_last_name", "customer_full_name", "customer_gender", "email"]
    return newest.select(
        "partner_id", "order_id", "order_date", "customer_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("taxful_total_price", "taxless_total_price")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_quantity", "total_unique_products")],
        F.coalesce("order_status", F.lit("pending")).alias("order_status"),
        *[F.coalesce(c, F.lit("[]")).alias(c) for c in ("category", "manufacturer", "products")],
        F.coalesce("geoip", F.lit("{}")).alias("geoip"))


def recent_clickstream(clicks: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` events of each partner with their product fields as a JSON text."""
    _positive(limit)
    newest = top_per_group(clicks, "partner_id", [F.desc("event_time"), F.desc("event_id")], limit, ["event_id"])
    props = F.concat(
        F.lit('{"product_name":"'), F.coalesce("product_name", F.lit("")),
        F.lit('","category":"'), F.coalesce("product_category", F.lit("")),
        F.lit('","price":'), F.coalesce(F.col("product_price").cast("string"), F.lit("0")), F.lit("}"))
    return newest.select("partner_id", "event_id", "event_type", "user_id", props.alias("event_properties"),
                         F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_timestamp"))


def parse_json_columns(orders: DataFrame) -> DataFrame:
    """JSON text columns as variants; bad text becomes ``[]`` (lists) or ``{}`` (geoip)."""
    def parsed(c: str, kind: str, empty: str) -> Column:
        v = F.try_parse_json(c)
        ok = F.schema_of_variant(v).startswith(kind)
        return F.coalesce(F.when(ok, v), F.parse_json(F.lit(empty)))
    return orders.select(
        "*", *[parsed(c, "ARRAY", "[]").alias(f"{c}_json") for c in ("category", "manufacturer", "products")],
        parsed("geoip", "OBJECT", "{}").alias("geoip_json"))


def lookup_orders(keys: DataFrame, orders: DataFrame) -> DataFrame:
    """For every wanted ``order_id``: is it present, and with which date."""
    wanted = keys.select("order_id").distinct()
    known = orders.select("order_id", "order_date").join(wanted, "order_id", "left_semi")
    dates = known.groupBy("order_id").agg(F.max("order_date").alias("order_date"))
    return (wanted.join(dates, "order_id", "left")
            .withColumn("found", F.col("order_date").isNotNull()))


def verify_sync(source: DataFrame, target: DataFrame, waited_ms: Column | int = 0) -> DataFrame:
    """Per source order: did it arrive, and how late; clock skew falls back to the wait."""
    arrived = target.select("order_id", F.col("order_date").alias("_target_date"))
    joined = source.select("order_id", "order_date").join(arrived, "order_id", "left")
    waited = waited_ms if isinstance(waited_ms, Column) else F.lit(waited_ms)
    lag = times.millis_between("order_date", "_target_date")
    latency = F.when(F.col("_target_date").isNull(), F.lit(0)).when(lag < 0, waited).otherwise(lag)
    return joined.select("order_id", F.col("_target_date").isNotNull().alias("synced"),
                         latency.cast("long").alias("latency_ms"))


def customer_name(user_id: Column | str) -> Column:
    """A fixed name per user: parity picks the list, the remainder picks the entry."""
    u = F.col(user_id) if isinstance(user_id, str) else user_id

    def pick(names: list[str], index: Column) -> Column:
        options = F.array(*[F.lit(n) for n in names])
        return F.element_at(options, (index % len(names) + 1).cast("int"))
    first = F.when(u % 2 == 0, pick(FIRST_NAMES_EVEN, u)).otherwise(pick(FIRST_NAMES_ODD, u))
    return F.concat_ws(" ", first, pick(LAST_NAMES, F.floor(u / 2)))


def recent_legacy_orders(orders: DataFrame, limit: int = 20) -> DataFrame:
    """Newest orders per partner with the derived customer name."""
    newest = top_per_group(orders, "partner_id", [F.desc("order_date"), F.desc("order_id")], limit, ["order_id"])
    return newest.select("partner_id", "order_id", "user_id", customer_name("user_id").alias("customer_name"),
                         "total_amount", "order_status", "order_date")


def catalogue_lookup(df: DataFrame, product_id: str) -> DataFrame:
    """Product name and category by id modulo the catalogue."""
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("name")) for c, n in PRODUCT_CATALOGUE])
    entry = F.element_at(entries, (F.pmod(F.col(product_id), F.lit(len(PRODUCT_CATALOGUE))) + 1).cast("int"))
    return df.select("*", entry["name"].alias("catalogue_name"), entry["category"].alias("catalogue_category"))


def line_totals(items: DataFrame) -> DataFrame:
    return items.withColumn("line_total", (F.col("unit_price").cast(MONEY) * F.col("quantity").cast("int")).cast("decimal(18,2)"))


def order_total(items: DataFrame) -> DataFrame:
    """Σ unit price × quantity per order."""
    return (line_totals(items).groupBy("order_id")
            .agg(F.sum("line_total").cast("double").alias("total_amount"), F.count("*").alias("lines")))


def orders_with_items(orders: DataFrame, items: DataFrame, page_size: int = 1000) -> DataFrame:
    """Orders with their items nested, in pages, so that an order may have any number of lines.

    ``line_no`` places an item on a page. Lines that repeat a number are counted
    together with their exact copies instead of being repeated in the list.
    """
    item = ["line_no", "product_id", "quantity", "unit_price"]
    merged = items.groupBy("order_id", *item).agg(F.count("*").alias("copies"))
    pages = collect_in_pages(merged, "order_id", F.col("line_no") - 1, F.struct(*item, "copies"), page_size)
    return (orders.select("order_id", "partner_id", "user_id", "order_status", "order_date")
            .join(pages, "order_id", "left")
            .withColumn("page", F.coalesce("page", F.lit(0)))
            .withColumn("items", F.coalesce("items", F.array())))


def with_dimension(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Attributes of a dimension row for each fact; Spark broadcasts it only if small."""
    return facts.join(dim, key, "left")


def data_age(df: DataFrame, ts: str, name: str, as_of=None) -> DataFrame:
    """How many rows are younger than 1, 3 and 7 days, in one scan."""
    now = times.as_of(df, ts, as_of)

    def younger(days: int) -> Column:
        return F.count_if(F.col(ts) >= times.ago(now, days, "day"))
    return df.agg(
        F.lit(name).alias("table_name"), F.count("*").alias("total_rows"),
        younger(1).alias("last_1_day"), younger(3).alias("last_3_days"), younger(7).alias("last_7_days"),
        F.count_if(F.col(ts) < times.ago(now, 3, "day")).alias("older_than_3_days"),
        F.min(ts).alias("oldest_record"), F.max(ts).alias("newest_record"))


def set_status(orders: DataFrame, updates: DataFrame, allowed: Sequence[str] = tuple(ORDER_STATUSES)) -> DataFrame:
    """Outcome of each requested change: applied, unknown order, or status not allowed."""
    old = orders.select("order_id", F.col("order_status").alias("old_status"))
    outcome = (F.when(~F.col("new_status").isin(*allowed), "invalid_status")
               .when(F.col("old_status").isNull(), "not_found").otherwise("updated"))
    return updates.join(old, "order_id", "left").withColumn("outcome", outcome)


def apply_status(orders: DataFrame, outcomes: DataFrame, version: str | None = None, now: Column | None = None) -> DataFrame:
    """The order table after the accepted changes, each order once.

    Of several accepted changes to one order the one with the highest ``version`` counts (a request number or time that
    ``outcomes`` carries), equal ones by status. ``now`` stamps ``updated_at`` of the changed orders, which change
    capture relies on.
    """
    accepted = outcomes.filter("outcome = 'updated'")
    order = F.struct(*([version] if version else []), "new_status")
    last = accepted.groupBy("order_id").agg(F.max(order).alias("_last")).select("order_id", F.col("_last.new_status").alias("_new"))
    changed = orders.join(last, "order_id", "left")
    if now is not None and "updated_at" in orders.columns:
        changed = changed.withColumn("updated_at", F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at")))
    return changed.withColumn("order_status", F.coalesce("_new", "order_status")).select(*orders.columns)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the delete list; call once per table of a header-lines pair."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def range_or_tenant(df: DataFrame, tenant: int, key: str = "user_id", tenant_col: str = "partner_id") -> DataFrame:
    """Rows of the tenant's key range, or owned by the tenant."""
    low = tenant * 100
    return df.filter(F.col(key).between(low, low + 999) | (F.col(tenant_col) == tenant))


def rolling_sum(series: DataFrame, keys: Sequence[str], order: str, value: str, n: int = 23) -> DataFrame:
    """Sum of the row and the ``n`` rows before it; feed it an aggregated series."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, Window.currentRow)
    return series.withColumn("rolling", F.sum(value).over(frame))


def percentile(df: DataFrame, value: str, prob: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Continuous percentile per group, exact for groups of any size."""
    return exact_percentiles(df, keys, value, [prob]).select(*keys, F.col("value").alias("percentile"))


def funnel_share(clicks: DataFrame, first_step: str = "view") -> DataFrame:
    """Events per step as a percentage of the first step."""
    steps = clicks.groupBy("event_type").agg(F.count("*").alias("count"))
    first = steps.filter(F.col("event_type") == first_step).select("count").scalar()
    return steps.select("event_type", "count", (F.col("count") * 100.0 / first).alias("pct"))


def latency_sla(samples: DataFrame, latency: str = "latency_ms", threshold: float = 500) -> DataFrame:
    """Samples over the threshold and the rounded mean."""
    return samples.agg(F.count("*").alias("samples"), F.count_if(F.col(latency) > threshold).alias("breaches"),
                       F.round(F.avg(latency)).cast("long").alias("mean_ms"))


def changelog_summary(changes: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Number of operations and the mean latency of those that report one."""
    return changes.agg(F.count("*").alias("operations"), F.count(latency).alias("timed"),
                       F.avg(latency).alias("mean_latency_ms"))
