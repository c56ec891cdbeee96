"""Stored tables that change by parts: a writer replaces some folders and publishes the new list of folders by one rename.

Readers open the newest list, so they never see half a change. A writer reads the versions before its own, which makes a
replayed micro-batch repeat its result. Folders that only lists older than the last two name are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from tidemark.sources import files

#: Published lists that stay readable; the older one serves readers that opened it before the newest appeared.
KEPT = 2


class _Published:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names(self.spark, f"{self.folder}/_parts") if n.endswith(".json"))

    def _list(self, before: int | None = None) -> dict:
        """The newest list, or the newest one older than a version."""
        fit = [v for v in self.versions() if before is None or v < before]
        return json.loads(files.get_text(self.spark, f"{self.folder}/_parts/{fit[-1]:012d}.json")) if fit else {"schema": None, "parts": {}}

    def _publish(self, version: int, schema: T.StructType, parts: dict[str, str]) -> None:
        files.put_text(self.spark, f"{self.folder}/_parts/{version:012d}.json", json.dumps({"schema": schema.json(), "parts": parts}))
        versions = self.versions()
        kept = {p for v in versions[-KEPT:] for p in self._at(v).values()}
        for old in versions[:-KEPT]:
            for path in set(self._at(old).values()) - kept:
                files.delete(self.spark, f"{self.folder}/{path}")
            files.delete(self.spark, f"{self.folder}/_parts/{old:012d}.json")

    def _at(self, version: int) -> dict[str, str]:
        return json.loads(files.get_text(self.spark, f"{self.folder}/_parts/{version:012d}.json"))["parts"]

    def _open(self, listed: dict, paths: Iterable[str]) -> DataFrame | None:
        if listed["schema"] is None:
            return None
        schema = T.StructType.fromJson(json.loads(listed["schema"]))
        found = sorted(set(paths))
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in found])


class PartedTable(_Published):
    """A table in parts named by a number, such as a key range or a hash bucket; a change rewrites the parts it touches."""

    def read(self, parts: Iterable[int] | None = None, before: int | None = None) -> DataFrame | None:
        """All parts or the given ones, of the newest version (or the newest older than ``before``); None if never written."""
        listed = self._list(before)
        have = listed["parts"]
        return self._open(listed, have.values() if parts is None else [have[str(p)] for p in parts if str(p) in have])

    def replace(self, rows: DataFrame, part: Column, version: int, touched: Iterable[int] | None = None) -> None:
        """Put ``rows`` in place of the ``touched`` parts (of all parts if None); touched parts without rows go."""
        path = f"data/{version}"
        (rows.withColumn("_part", part).repartition("_part").write.mode("overwrite").partitionBy("_part")
         .parquet(f"{self.folder}/{path}"))
        parts = {} if touched is None else self._list(version)["parts"]
        for gone in touched or ():
            parts.pop(str(gone), None)
        for name in files.names(self.spark, f"{self.folder}/{path}"):
            if name.startswith("_part="):
                parts[name[6:]] = f"{path}/{name}"
        self._publish(version, rows.schema, parts)


class LevelledTable(_Published):
    """A table of batches: ``fan`` folders of a level are merged into one of the next, so n batches are read from at most
    ``(fan - 1) * (1 + log(n, fan))`` folders, and a row is rewritten once a level."""

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows, fan: int = 4):
        super().__init__(spark, folder)
        self.merge, self.fan = merge, fan

    def read(self, before: int | None = None) -> DataFrame | None:
        """All stored rows; None if never written."""
        listed = self._list(before)
        return self._open(listed, listed["parts"].values())

    def parts(self) -> dict[str, str]:
        """The folders that hold the newest version, by level and batch."""
        return self._list()["parts"]

    def add(self, rows: DataFrame, version: int) -> None:
        schema, parts, level = rows.schema, self._list(version)["parts"], 0
        path = f"data/{version}-0"
        rows.write.mode("overwrite").parquet(f"{self.folder}/{path}")
        parts[f"0-{version}"] = path
        while len(full := [n for n in parts if n.startswith(f"{level}-")]) >= self.fan:
            stored = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{parts.pop(n)}" for n in full])
            level += 1
            path = f"data/{version}-{level}"
            self.merge(stored).select(*schema.names).write.mode("overwrite").parquet(f"{self.folder}/{path}")
            parts[f"{level}-{version}"] = path
        self._publish(version, schema, parts)
