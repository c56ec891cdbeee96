"""Removal of repeated word passages through a compacted De Bruijn graph of the corpus.

An edge is a window of ``window`` words, its nodes are the window without its last or first word. Consecutive edges
that share their least short word gram (their minimiser) form a path; equal edges share it too, so all copies of an
edge meet in the bucket of the minimiser. There each edge finds its earliest place. Repeated edges that follow one
another at the same distance from their sources form nonbranching paths: first within a task, then, across buckets,
by Spark's grouping on document, source and distance. A compacted path is a long repeated span with its source's
coordinates; the span's and the source's words are compared by a digest of the text itself before anything goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm import common

GRAM = 8  # words of a minimiser
PER_BUCKET = 250_000  # edges that one bucket holds about
PER_GROUP = 1 << 20  # text bytes of one group of documents about
KEY = "_dedup_key"  # number of a row where some have no id
SPANS = "doc long, start int, n int, src_doc long, src_start int"
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("src_doc", "<i8"), ("src_start", "<i4")])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:len(values) - width + have], values[width - have:]) if have < width else values


def _spans(doc, place, src_doc, src_place, follows) -> np.ndarray:
    """Paths of repeated edges, given in order; an edge joins the path before it if it ``follows`` and its source too."""
    out = np.zeros(0, _SPAN)
    if len(doc):
        joined = follows & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1) \
            & (src_doc[1:] == src_doc[:-1]) & (src_place[1:] == src_place[:-1] + 1)
        first, sizes = common.runs(np.concatenate([[True], ~joined]))
        out = np.zeros(len(first), _SPAN)
        out["doc"], out["start"], out["n"], out["src_doc"], out["src_start"] = doc[first], place[first], sizes, src_doc[first], src_place[first]
    return out


def paths(docs: DataFrame, window: int, buckets: int, text: str, doc_id: str) -> DataFrame:
    """``bucket, edges, spans``: the first edges of each value in a slice of a task, in paths by minimiser; the others
    already as repeated spans."""
    def task(batches):
        for batch in batches:
            batch, ids = common.sorted_by_id(batch, doc_id)
            offsets, data = common.utf8(batch.column(batch.schema.get_field_index(text)))
            made = []
            for first, last in common.slices(offsets):
                local = offsets[first:last + 1] - offsets[first]
                hashes, _, _, word = common.words(local, data[offsets[first]:offsets[last]])
                counts = np.diff(word)
                edges = common.within(word[:-1], np.maximum(counts - window + 1, 0))
                if not len(edges):
                    continue
                owner = np.repeat(np.arange(last - first), np.maximum(counts - window + 1, 0))
                doc, place = ids[first:last][owner], (edges - word[owner]).astype(np.int64)
                value = common.rolling(hashes, window)[edges]
                least = _least(common.rolling(hashes, GRAM), window - GRAM + 1)[edges]
                order = np.argsort(value, kind="stable")
                same = value[order][1:] == value[order][:-1]
                group = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
                source = np.empty(len(order), np.int64)
                source[order] = order[group]
                again = (doc[source] != doc) | (place[source] != place)
                at = np.flatnonzero(again)
                spans = _spans(doc[at], place[at], doc[source[at]], place[source[at]], np.diff(at) == 1)
                made.append((least[~again], doc[~again], place[~again], value[~again], np.flatnonzero(~again), spans))
            yield _blobs(made, buckets)
        common.give_back()

    return docs.select(doc_id, text).mapInArrow(task, "bucket long, edges binary, spans binary")


def _blobs(made: list, buckets: int) -> pa.RecordBatch:
    names, edges, spans = [], [], []
    for least, doc, place, value, index, local in made:
        if len(local):
            names.append(int(local["doc"][0]) % buckets)
            edges.append(None)
            spans.append(local.tobytes())
        if not len(least):
            continue
        begin = np.concatenate([[True], (np.diff(index) != 1) | (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])])
        first, sizes = common.runs(begin)
        bucket = (least[first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, sizes, bucket = first[order], sizes[order], bucket[order]
        value = value[common.within(first, sizes)]
        ends = np.cumsum(sizes)
        bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = value[ends[a] - sizes[a]:ends[b - 1]]
            names.append(int(bucket[a]))
            edges.append(b"".join([np.array([b - a, len(part)], "<i8").tobytes(), least[first[a:b]].tobytes(), common.planes(doc[first[a:b]]),
                                   common.planes(place[first[a:b]].astype("<i4")), common.planes(sizes[a:b].astype("<i4")),
                                   (part >> np.uint64(32)).astype("<u4").tobytes(), (part & np.uint64(255)).astype(np.uint8).tobytes()]))
            spans.append(None)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(edges, pa.binary()), pa.array(spans, pa.binary())],
                                      names=["bucket", "edges", "spans"])


def _read(blob: bytes):
    count, total = np.frombuffer(blob, "<i8", 2)
    at = 16
    least = np.frombuffer(blob, "<u8", count, at)
    doc = common.from_planes(blob, at + 8 * count, count, "<i8")
    place = common.from_planes(blob, at + 16 * count, count, "<i4")
    sizes = common.from_planes(blob, at + 20 * count, count, "<i4")
    at += 24 * count
    value = (np.frombuffer(blob, "<u4", total, at).astype(np.uint64) << np.uint64(8)) | np.frombuffer(blob, np.uint8, total, at + 4 * total)
    return least, doc, place, sizes, value


def _resolve(table: pa.Table) -> pa.Table:
    """Spans of the edges of one bucket that start earlier elsewhere; spans of earlier steps pass through."""
    found = [np.frombuffer(s, _SPAN) for s in table["spans"].to_pylist() if s]
    blobs = [_read(b) for b in table["edges"].to_pylist() if b]
    if blobs:
        least, doc, place, sizes, value = (np.concatenate(c) for c in zip(*blobs))
        order = np.lexsort((place, doc))
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order].astype(np.int64)
        value = value[common.within(begin, sizes)]
        steps = common.within(np.zeros(len(sizes), np.int64), sizes)
        doc, place = np.repeat(doc[order], sizes), np.repeat(place[order], sizes) + steps
        key = common.mix(np.repeat(least[order], sizes) * common.BASE + value)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        group = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
        source = np.empty(len(order), np.int64)
        source[order] = order[group]
        at = np.flatnonzero((doc[source] != doc) | (place[source] != place))
        found.append(_spans(doc[at], place[at], doc[source[at]], place[source[at]], np.diff(at) == 1))
    spans = np.concatenate(found) if found else np.zeros(0, _SPAN)
    common.give_back()
    return pa.table({n: spans[n] for n in _SPAN.names})


def repeated_spans(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id", size: int | None = None) -> DataFrame:
    """``doc, start, n, src_doc, src_start``: maximal chains of ``n`` repeated windows with one earlier source each."""
    size = common.volume(docs, text)[1] if size is None else size
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 6 // PER_BUCKET)
    found = paths(docs, window, buckets, text, doc_id).groupBy("bucket").applyInArrow(_resolve, SPANS)
    chain = Window.partitionBy("doc", "src_doc", "shift").orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    linked = (found.withColumn("shift", F.col("start") - F.col("src_start"))
              .withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
              .withColumn("path", F.sum("new").over(chain)))
    return (linked.groupBy("doc", "src_doc", "shift", "path")
            .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"))
            .select("doc", "start", (F.col("stop") - F.col("start")).alias("n"), "src_doc", (F.col("start") - F.col("shift")).alias("src_start")))


def _texts(table: pa.Table, text: str, doc_id: str):
    """Rows of a group of documents: number, id, bytes, and their words' starts and ends."""
    table = table.combine_chunks()
    ids = pc.fill_null(table[doc_id].cast(pa.int64()), common.LAST_ID).to_numpy()
    column = table[text]
    offsets, data = common.utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    for first, last in common.slices(offsets):
        part = data[offsets[first]:offsets[last]]
        local = offsets[first:last + 1] - offsets[first]
        _, starts, ends, word = common.words(local, part)
        for k in range(last - first):
            a, b = word[k], word[k + 1]
            yield first + k, ids[first + k], part[local[k]:local[k + 1]], starts[a:b] - local[k], ends[a:b] - local[k]


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> bytes:
    """Digest of words first..last-1, whatever white space parts them."""
    words = raw[starts[first]:ends[last - 1]].split() if last > first else []
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _keyed(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, str]:
    """The table and the column that numbers its documents: the id, but where ids are null, numbers above all ids for those rows."""
    number = F.col(doc_id).cast("long")
    most, nulls = docs.agg(F.max(number), F.count_if(number.isNull())).first()
    most = max(most or 0, 0)
    if not nulls or most == common.LAST_ID:
        return docs, doc_id
    above = F.lit(most + 1) + F.pmod(F.xxhash64(text), F.lit(common.LAST_ID - most))
    return docs.withColumn(KEY, F.coalesce(number, above)), KEY


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
          T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id", kept_text: bool = True) -> DataFrame:
    """Every row with ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one space) and ``kept_text``
    (the text without the removed words and the white space behind each).

    A word is a run of bytes other than 0x20 and 0x09-0x0D. It is removed if a window of ``window`` words that covers it
    also starts earlier: at a smaller id, or earlier in the same text. Windows are judged on the input. A null or empty
    text has no words (null stays null as ``kept_text``); a null id counts as larger than all others, and rows without an
    id are ordered by a digest of their texts. Rows that repeat an id, or have none and equal texts, are one document, not
    copies of each other. Columns of the new names are replaced, all others pass through.
    """
    rows, size = common.volume(docs, text)
    groups = max(1, size // PER_GROUP, rows // 20_000)
    fields = FIELDS if kept_text else FIELDS[:3]
    keep = [c for c in docs.columns if c not in {f.name for f in fields}]
    docs, key = _keyed(docs.select(*keep), text, doc_id)
    spans = repeated_spans(docs, window, text, key, size)

    def mark(texts: pa.Table, about: pa.Table) -> pa.Table:
        wanted: dict[int, dict] = {}
        columns = [about[n].to_numpy() for n in _SPAN.names]
        for k, src in enumerate(columns[3].tolist()):
            wanted.setdefault(src, {}).setdefault((int(columns[4][k]), int(columns[2][k])), []).append(k)
        out = [None] * about.num_rows
        for _, doc, raw, starts, ends in _texts(texts, text, key):
            if doc in wanted:
                raw = bytes(raw)
                for (start, n), spans_of in wanted.pop(doc).items():
                    digest = _digest(raw, starts, ends, start, min(start + n + window - 1, len(starts)))
                    for k in spans_of:
                        out[k] = digest
        return pa.table({"doc": about["doc"], "start": about["start"], "n": about["n"], "digest": pa.array(out, pa.binary())})

    def cut(texts: pa.Table, about: pa.Table) -> pa.Table:
        doc_of, start_of, n_of = (about[n].to_numpy() for n in ("doc", "start", "n"))
        digests = about["digest"].to_pylist()
        mine: dict[int, list[int]] = {}
        for k, doc in enumerate(doc_of.tolist()):
            mine.setdefault(doc, []).append(k)
        columns = [[], [], [], []]
        valid = texts[text].is_valid().to_pylist()
        for row, doc, raw, starts, ends in _texts(texts, text, key):
            n, raw = len(starts), bytes(raw)
            gone = np.zeros(n, bool)
            if doc in mine:
                sure = [k for k in mine[doc] if start_of[k] + n_of[k] + window - 1 <= n and digests[k] == _digest(
                    raw, starts, ends, int(start_of[k]), int(start_of[k] + n_of[k] + window - 1))]
                gone = common.covered(start_of[sure].astype(np.int64), (start_of[sure] + n_of[sure] + window - 1).astype(np.int64), n)
            columns[0].append(n)
            columns[1].append(int(gone.sum()))
            begin, sizes = common.runs(np.concatenate([[True], gone[1:] != gone[:-1]])) if n else (np.zeros(0, int), np.zeros(0, int))
            stays = [(a, a + s) for a, s in zip(begin.tolist(), sizes.tolist()) if not gone[a]]
            words = b" ".join(b" ".join(raw[starts[a]:ends[b - 1]].split()) for a, b in stays)
            columns[2].append(hashlib.sha256(words).hexdigest())
            if not valid[row]:
                columns[3].append(None)
            elif gone.any():
                limit = np.append(starts, len(raw))
                columns[3].append(b"".join([raw[:starts[0]], *(raw[limit[a]:limit[b]] for a, b in stays)]).decode("utf-8", "replace"))
            else:
                columns[3].append(raw.decode("utf-8", "replace"))
        common.give_back()
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))][:len(fields)]
        kept = [texts[c] for c in keep]
        return pa.Table.from_arrays(kept + made, names=keep + [f.name for f in fields])

    marked = common.meet(docs, key, spans, "src_doc", groups, mark, "doc long, start int, n int, digest binary")
    return common.meet(docs, key, marked, "doc", groups, cut, T.StructType([docs.schema[c] for c in keep] + fields))
