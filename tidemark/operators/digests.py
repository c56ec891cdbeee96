"""Change detection by a tree of digests over key ranges.

A leaf counts the rows of one key range and adds up their hashes; an inner node digests the 64 nodes below it. Two tables
are compared from the top: only below nodes that differ is anything read, down to the ranges that hold a difference.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.parted import PartedTable

FAN_BITS = 6  # 64 nodes below a node
DEPTH = 2  # levels below the top: 4096 ranges hang below one top node
BITS = 12  # 4096 keys in a range


def range_of(key: str, bits: int = BITS) -> Column:
    """Number of the range of 2**bits integer keys that holds a key; null keys have one of their own."""
    return F.coalesce(F.shiftright(F.col(key).cast("long"), bits), F.lit(-2**62))


def leaves(rows: DataFrame, key: str, columns: Sequence[str] | None = None, bits: int = BITS) -> DataFrame:
    """``node, rows, digest`` of each key range; the digest adds up the halves of the rows' hashes over the given columns
    (all by default), so it does not depend on their order."""
    parts = F.xxhash64(*(columns or rows.columns))
    high, low = F.shiftright(parts, 32), parts.bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.groupBy(range_of(key, bits).alias("node")).agg(
        F.count("*").alias("rows"), F.concat_ws(":", F.sum(high), F.sum(low)).alias("digest"))


class DigestTree:
    """The stored digests of a table; ``update`` takes the leaves of changed ranges, ``differing`` finds them again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.levels = [PartedTable(spark, f"{folder}/level={level}") for level in range(DEPTH + 1)]

    def update(self, leaves: DataFrame, touched: Iterable[int] | None, version: int) -> None:
        """Put ``leaves`` in place of the ``touched`` ranges' digests (of all if None), and renew the nodes above them."""
        nodes = None if touched is None else set(touched)
        for table in self.levels:
            parts = None if nodes is None else {n >> FAN_BITS for n in nodes}
            old = None if nodes is None else table.read(parts, before=version)
            if old is not None:
                gone = self.spark.createDataFrame([(n,) for n in nodes], "node long")
                leaves = leaves.unionByName(old.join(gone, "node", "left_anti"))
            above = F.shiftright("node", FAN_BITS)
            table.replace(leaves, above, version, parts)
            now = table.read(parts, before=version + 1)
            leaves = now.groupBy(above.alias("node")).agg(
                F.sum("rows").alias("rows"), F.md5(F.array_join(F.array_sort(F.collect_list(
                    F.concat_ws("=", "node", "rows", "digest"))), ",")).alias("digest"))
            nodes = parts

    def differing(self, other: "DigestTree", mine: int | None = None, theirs: int | None = None) -> list[int]:
        """Ranges whose rows differ between the two tables (of versions older than ``mine`` and ``theirs``)."""
        parts = None
        for left, right in zip(reversed(self.levels), reversed(other.levels)):
            a, b = left.read(parts, before=mine), right.read(parts, before=theirs)
            if a is None and b is None:
                return []
            if a is None or b is None:
                found = (b if a is None else a).select("node")
            else:
                b = b.select(F.col("node").alias("_node"), F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
                same = (F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest"))
                found = (a.join(b, F.col("node") == F.col("_node"), "full_outer").filter(~F.coalesce(same, F.lit(False)))
                         .select(F.coalesce("node", "_node").alias("node")))
            # One number for each differing node: at most one a key range, never a row.
            parts = [r["node"] for r in found.collect()]
            if not parts:
                return []
        return sorted(parts)


class RangedTable:
    """Rows in key ranges with their digest tree; a change renews the digests of the ranges it touches.

    The rows of 64 ranges share a folder, as their digests do, so there are few files however many ranges a table has. A
    change rewrites the folders of its ranges; their other ranges are carried over as they are.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, bits: int = BITS):
        self.spark, self.key, self.bits = spark, key, bits
        self.rows, self.tree = PartedTable(spark, f"{folder}/rows"), DigestTree(spark, f"{folder}/digests")

    def version(self) -> int:
        """The newest version whose rows and digests are both there; -1 if there is none."""
        done = self.tree.levels[-1].versions()
        return done[-1] if done else -1

    def read(self, ranges: Iterable[int] | None = None, before: int | None = None) -> DataFrame | None:
        """All rows, or those of the given ranges, whose folders alone are opened."""
        if ranges is None:
            return self.rows.read(None, before)
        return self._of(ranges, "left_semi", before)

    def _of(self, ranges: Iterable[int], how: str, before: int | None) -> DataFrame | None:
        """Rows in the given ranges, or the others in their folders; one number a range is broadcast."""
        wanted = set(ranges)
        found = self.rows.read({r >> FAN_BITS for r in wanted}, before)
        if found is None:
            return None
        listed = F.broadcast(self.spark.createDataFrame([(r,) for r in wanted], "_range long"))
        return found.join(listed, range_of(self.key, self.bits) == F.col("_range"), how)

    def touched(self, keys: DataFrame) -> list[int]:
        """The ranges of these keys."""
        return sorted(r[0] for r in keys.select(range_of(self.key, self.bits)).distinct().collect())

    def replace(self, rows: DataFrame, version: int, ranges: Iterable[int] | None = None) -> None:
        """``rows`` take the place of the given ranges, or of the whole table."""
        folder = F.shiftright(range_of(self.key, self.bits), FAN_BITS)
        if ranges is None:
            self.rows.replace(rows, folder, version)
        else:
            ranges = set(ranges)
            others = self._of(ranges, "left_anti", version)
            whole = rows if others is None else rows.unionByName(others)
            self.rows.replace(whole, folder, version, {r >> FAN_BITS for r in ranges})
        self.tree.update(leaves(self.read(ranges, before=version + 1), self.key, bits=self.bits), ranges, version)
