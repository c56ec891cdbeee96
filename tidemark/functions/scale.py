"""Ranking, quantile and grouping helpers that never gather a hot group in one task.

A single key may hold a third of all rows. Each helper either shrinks a group
before the shuffle (partial limits, partial counts) or spreads it over ordered
ranges of its values whose sizes are combined through a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _names(cols: Sequence[str] | str | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def top_per_group(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Column], k: int,
                  spread_by: Sequence[str], rank: str | None = None, salts: int = 16) -> DataFrame:
    """First ``k`` rows of each group in a total order.

    The filter on ``row_number`` makes Spark keep at most ``k`` rows per group in
    every map task. The salted first pass then keeps the merge of those
    survivors parallel for a hot group before the final pass.
    """
    keys = _names(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    first = (salted
             .withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
             .filter(F.col("_pos") <= k))
    out = rank or "_rank"
    final = (first.drop("_salt", "_pos")
             .withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
             .filter(F.col(out) <= k))
    return final if rank else final.drop(out)


#: Distinct values of a group that one task may sort, and ranges into which a larger group (or range) is cut.
VALUES, CUTS = 20_000, 64


def _cut(rows: DataFrame, by: list[str], value: str, number: str) -> DataFrame:
    """``number``: the range of a row's value inside its group ``by``; 0 in groups of few rows.

    Only groups beyond ``VALUES`` rows are cut. Their cut points are quantiles of their own values, from a mergeable summary, so that ranges
    are about equally full however close the values lie.
    """
    large = rows.groupBy(*by).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > VALUES).select(*by)
    shares = [k / CUTS for k in range(1, CUTS)]
    cuts = rows.join(large, by, "left_semi").groupBy(*by).agg(F.percentile_approx(value, shares, 20 * CUTS).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    return rows.join(cuts, by, "left").withColumn(number, F.greatest(F.coalesce(place, F.lit(0)), F.lit(0))).drop("_cuts")


def in_ranges(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``_bucket``: number of a value's range inside its group, in the order of the values; ``rows`` hold a value of a group once.

    Ranges that are still too large are cut once more by their own values, so it takes over ``VALUES * CUTS ** 2`` distinct values
    in one group before ranges grow.
    """
    by = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    fine = _cut(_cut(rows, by, value, "_coarse"), by + ["_coarse"], value, "_fine")
    return fine.withColumn("_bucket", F.col("_coarse") * (CUTS + 1) + F.col("_fine")).drop("_coarse", "_fine", "_all")


def _bucket_offsets(counted: DataFrame, keys: list[str], descending: bool) -> DataFrame:
    """Rows that precede each bucket, and the group total; one small row per bucket."""
    sizes = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys, "_bucket", "_size",
        F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_total"))


def with_dense_rank(df: DataFrame, keys: Sequence[str] | str, value: str, rank: str,
                    descending: bool = True) -> DataFrame:
    """``dense_rank`` over a group of any size; nulls share the last rank.

    Distinct values are ranked inside ranges cut from the data, and a range's offset
    is the number of distinct values in the ranges before it.
    """
    keys = _names(keys)
    values = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    distinct = in_ranges(values, keys, value).withColumn("_n", F.lit(1))
    offsets = _bucket_offsets(distinct, keys, descending)
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    ranked = (distinct.join(offsets, keys + ["_bucket"])
              .select(*keys, value, (F.col("_before") + F.row_number().over(inside)).alias(rank)))
    last = distinct.groupBy(*keys).agg((F.count("*") + 1).alias("_last"))
    out = df.join(ranked, keys + [value], "left")
    if keys:
        out = out.join(last, keys, "left")
        tail = F.coalesce(F.col("_last"), F.lit(1))
    else:
        tail = last.select("_last").scalar()
    return out.withColumn(rank, F.coalesce(F.col(rank), tail)).drop("_last")


def exact_percentiles(df: DataFrame, keys: Sequence[str] | str | None, value: str,
                      probs: Sequence[float], interpolate: bool = True) -> DataFrame:
    """Exact percentiles as rows ``(*keys, prob, value)``.

    Values are counted first (a map-side combine). Totals of ranges cut from the
    data locate those that hold a wanted position, and only those are sorted.
    """
    keys = _names(keys)
    counted = in_ranges(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value)
    offsets = _bucket_offsets(counted, keys, descending=False)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    # Continuous: linear between neighbours. Discrete: the first value that covers the share.
    position = (F.col("prob") * (F.col("_total") - 1) if interpolate
                else F.greatest(F.ceil(F.col("prob") * F.col("_total")) - 1, F.lit(0)))
    targets = (offsets.withColumn("prob", F.explode(wanted))
               .withColumn("_pos", position)
               .withColumn("_lo", F.floor("_pos"))
               .withColumn("_hi", F.ceil("_pos") if interpolate else F.floor("_pos"))
               .filter((F.col("_lo") < F.col("_before") + F.col("_size"))
                       & (F.col("_hi") >= F.col("_before"))))
    hit = targets.select(*keys, "_bucket", "_before").distinct()
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (counted.join(hit, keys + ["_bucket"])
            .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
            .withColumn("_start", F.col("_end") - F.col("_n"))
            .select(*keys, "_bucket", F.col(value).alias("_v"), "_start", "_end"))
    found = runs.join(targets.select(*keys, "_bucket", "prob", "_pos", "_lo", "_hi"), keys + ["_bucket"])

    def at(pos: str) -> Column:
        inside_run = (F.col(pos) >= F.col("_start")) & (F.col(pos) < F.col("_end"))
        return F.max(F.when(inside_run, F.col("_v")))

    ends = (found.groupBy(*keys, "prob", "_pos", "_lo")
            .agg(at("_lo").alias("_low"), at("_hi").alias("_high")))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    picked = F.when(low == high, low).otherwise(low + (high - low) * (F.col("_pos") - F.col("_lo")))
    return ends.select(*keys, "prob", picked.alias("value") if interpolate else F.col("_low").alias("value"))


def collect_in_pages(df: DataFrame, keys: Sequence[str] | str, position: Column,
                     item: Column, page_size: int, items: str = "items") -> DataFrame:
    """Nest rows below their key in pages of at most ``page_size`` positions.

    A group of any length becomes several rows ``(*keys, page, items)``; ordinary
    groups fit in page 0, so nothing is dropped and no task holds a whole hot key.
    """
    keys = _names(keys)
    return (df.withColumn("_position", position)
            .withColumn("page", F.floor(F.col("_position") / page_size).cast("int"))
            .groupBy(*keys, "page")
            .agg(F.array_sort(F.collect_list(item)).alias(items)))
