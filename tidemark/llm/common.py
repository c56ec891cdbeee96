"""Helpers shared by the operators: Arrow text access, hashing in numpy, appended columns, scratch tables."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.session import shared_dir

#: Bytes of text that the numpy steps take at once; bounds their temporary arrays, not the texts.
SLICE_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer text stands alone and whole."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the rolling hashes; powers wrap modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of every ``width`` consecutive 64-bit values; doubles the width, then adds what is missing.

    Each step combines two shorter hashes and mixes them again, so that the quality does not depend on the values.
    """
    done, have, out, at = values, 1, None, 0
    left = width
    while left:
        if left & 1:
            out = done if out is None else _pair(out, done, at)
            at += have
        left >>= 1
        if left:
            done = _pair(done, done, have)
            have *= 2
    return out[:max(0, len(values) - width + 1)]


def _pair(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    n = min(len(a), len(b) - shift)
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(a[:n] * BASE + b[shift:shift + n] + np.uint64(shift))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWER = powers(1 << 16)
_INVERSE = powers(1 << 16, np.uint64(pow(int(BASE), -1, 1 << 64)))


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D, or other than those marked in ``space``) of consecutive texts.

    Returns for each word its hash, first byte and end in ``data``, and for each text the number of its first word
    (with the total at the end). Words never cross texts.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    codes = _BYTE[_LOWER[data] if lower else data]
    codes[~inside] = 0
    power, inverse = (_POWER, _INVERSE) if n < len(_POWER) else _long_powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _long_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for a slice of n bytes; one table, for the usual slice size, is kept per worker."""
    usual = SLICE_BYTES + 1
    if n <= usual:
        if usual not in _KEPT:
            _KEPT[usual] = powers(usual), powers(usual, _INVERSE[1])
        return _KEPT[usual]
    return powers(n), powers(n, _INVERSE[1])


def give_back() -> None:
    """Return freed memory to the system at the end of a task: its process waits for later stages beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


#: Rows and bytes of a batch on its way to a task's Python; texts may be long, and two tasks share an executor.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what these operators are sized for; never raise them."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(name, None)
        number = int(re.sub(r"\D", "", have) or 0) if have else 0
        if not 0 < number <= most or not have.isdigit():
            spark.conf.set(name, most)


def append(df: DataFrame, needs: list[str], fields: list[T.StructField], make: Callable) -> DataFrame:
    """All columns of ``df`` and the new ``fields``; a column with the name of a new field is replaced.

    ``make()`` runs once in a task and returns a function from the needed Arrow arrays to the new arrays.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in schema]

    def task(batches):
        compute = make()
        for batch in batches:
            made = compute(*[batch.column(batch.schema.get_field_index(c)) for c in needs])
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(old + list(made), names=names)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def held_out(doc_id: str) -> Column:
    """True where crc32 of the id's decimal text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def least_draws(rows: DataFrame, group: str, draw: str, n: int) -> DataFrame:
    """Rows that can be among the ``n`` of least ``draw``, a 64-bit hash, in their group: all of those, and few others.

    Ranges of the hash are counted first; only rows of the ranges that hold the first ``n`` go on, so no group gathers.
    """
    cut = F.shiftright(draw, 52)  # 4096 ranges in the order of the hash
    before = F.sum("count").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = (rows.groupBy(group, cut.alias("_range")).count().withColumn("_before", F.coalesce(before, F.lit(0)))
             .filter(F.col("_before") < n).select(group, "_range"))
    return rows.withColumn("_range", cut).join(first, [group, "_range"], "left_semi").drop("_range")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a step below the shared folder and read it back: recomputation stops here when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``scratch``."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Id that stands for a null id: after all others.
LAST_ID = 2**63 - 1


def planes(values: np.ndarray) -> bytes:
    """Numbers with their bytes dealt into planes, so that bytes that are always zero cost nothing in a shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(blob: bytes, at: int, count: int, kind) -> np.ndarray:
    """Undo ``planes`` for ``count`` numbers that start at byte ``at``."""
    size = np.dtype(kind).itemsize
    parts = np.frombuffer(blob, np.uint8, count * size, at).reshape(size, count)
    return np.ascontiguousarray(parts.T).reshape(-1).view(kind)


def volume(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and text bytes of a table; sizes the groups of later steps."""
    small_batches(docs.sparkSession)
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return rows, size or 0


def sorted_by_id(batch: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch in the order of its ids, and the ids with null last."""
    ids = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.int64()), LAST_ID).to_numpy(zero_copy_only=False)
    if (ids[1:] < ids[:-1]).any():
        order = np.argsort(ids, kind="stable")
        return batch.take(pa.array(order)), ids[order]
    return batch, ids


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, lengthened until no frame has such a column."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def meet(docs: DataFrame, doc_id: str, rows: DataFrame, key: str, groups: int, work: Callable, schema) -> DataFrame:
    """Documents and the rows about them, met in ``groups`` groups of documents by the hash of the id.

    ``work`` takes the two Arrow tables of a group. The documents' shuffle is the same in every call, so Spark reuses it
    within one plan.
    """
    def group(column):
        return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))), F.lit(groups))

    name = free_name("_group", docs, rows)
    left = docs.withColumn(name, group(doc_id)).groupBy(name)
    right = rows.withColumn(name, group(key)).groupBy(name)
    return left.cogroup(right).applyInArrow(work, schema)


def runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run, given where a new run begins (the first entry must)."""
    first = np.flatnonzero(breaks)
    return first, np.diff(np.append(first, len(breaks)))


def within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True at every place below n that some range covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(starts, n), 1)
    np.add.at(change, np.minimum(ends, n), -1)
    return np.cumsum(change[:-1]) > 0
