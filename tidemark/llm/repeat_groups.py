"""Removal of repeated byte strings by an enhanced suffix array over sampled suffixes.

Every window of ``window`` bytes has a leftmost least gram (its anchor). Windows with one anchor form a run; equal
windows have equal anchors at equal offsets, so it is enough to compare suffixes that start at anchors, together with
what stands before them. Runs with equal bytes are found by a digest of the whole run. Where an anchor occurs in runs
that differ, the runs' bytes meet: their suffixes are sorted, common prefix lengths are scanned with a stack, and each
interval of the tree is tested for the diversity of its left extensions, which yields the maximal repeats with all
their occurrences. An anchor with very many different runs is settled by the digests of its windows instead, dealt by
digest over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import common

PER_BUCKET = 200_000  # runs that one bucket holds about
PER_GROUP = 1 << 20  # text bytes of one group of documents about
KEY = "_repeat_key"  # digest of id and text: rows that differ in either are documents of their own
SCAN = 256  # different runs of an anchor that one scan takes
_RUN = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("at", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
_OPEN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4"), ("at", "<i4"), ("hot", "<i4")])
_WINDOW = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("start", "<i4")])


def _anchors(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of every ``width`` consecutive values and its leftmost place."""
    place, have = np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left = values[:-step] <= values[step:]
        values, place = np.where(left, values[:-step], values[step:]), np.where(left, place[:-step], place[step:])
        have += step
    return values, place


def _range_digest(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return common.mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give the digest of any range, and the inverse powers they need."""
    power, inverse = common._long_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(common._BYTE[data] * power[:len(data)], out=sums[1:])
    return sums, inverse


def _by_bucket(bucket: np.ndarray, rows: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(rows) else [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield int(bucket[a]), rows[a:b].tobytes()


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


BLOBS = "bucket long, kind int, blob binary"
SPANS, RUNS, WINDOWS = 0, 1, 2


def _repeated(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows share their key with another place, and the first row of each key."""
    order = np.lexsort((start, doc, key))
    k, d, s = key[order], doc[order], start[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    other = np.concatenate([[False], (k[1:] == k[:-1]) & ((d[1:] != d[:-1]) | (s[1:] != s[:-1]))])
    group = np.cumsum(new) - 1
    many = np.bincount(group, other, minlength=group[-1] + 1 if len(group) else 0) > 0
    repeated = np.empty(len(key), bool)
    repeated[order] = many[group] if len(group) else []
    return repeated, order[new] if len(order) else order


def _runs(docs: DataFrame, window: int, gram: int, buckets: int, text: str) -> DataFrame:
    """Blobs of runs by anchor, one for each run value in a slice of a task; runs seen twice there as spans."""
    def task(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(KEY)).to_numpy()
            offsets, data = common.utf8(batch.column(batch.schema.get_field_index(text)))
            rows: list = []
            for first, last in common.slices(offsets):
                part, local = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
                counts = np.maximum(np.diff(local) - window + 1, 0)
                windows = common.within(local[:-1], counts)
                if not len(windows):
                    continue
                least, place = _anchors(common.rolling(common._BYTE[part], gram), window - gram + 1)
                owner = np.repeat(np.arange(last - first), counts)
                least, place = least[windows], place[windows]
                begin, sizes = common.runs(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
                sums, inverse = _sums(part)
                run = np.zeros(len(begin), _RUN)
                start = windows[begin]
                run["anchor"], run["doc"], run["n"] = least[begin], ids[first:last][owner[begin]], sizes
                run["start"], run["at"] = start - local[owner[begin]], place[begin] - start
                run["digest"] = common.mix(_range_digest(sums, inverse, start, start + sizes + window - 1) + run["at"].astype(np.uint64))
                again, one = _repeated(common.mix(run["anchor"] + run["digest"] * common.BASE), run["doc"], run["start"])
                if again.any():
                    rows.append((int(run["doc"][0]) % buckets, SPANS, _as_spans(run[again], window).tobytes()))
                one = run[np.sort(one)]
                rows += [(b, RUNS, blob) for b, blob in _by_bucket((one["anchor"] % np.uint64(buckets)).astype(np.int64), one)]
            yield from _batch(rows).to_batches()
        common.give_back()

    return docs.select(KEY, text).mapInArrow(task, BLOBS)


def _as_spans(run: np.ndarray, window: int) -> np.ndarray:
    """Bytes that runs cover, touching ones of a document joined."""
    run = run[np.lexsort((run["start"], run["doc"]))]
    end = run["start"] + run["n"] + window - 1
    return _joined(run["doc"], run["start"], end)


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans in order of document and start, with those that touch joined."""
    if not len(doc):
        return np.zeros(0, _SPAN)
    wide = end + (doc != np.roll(doc, 1)).cumsum().astype(np.int64) * (1 << 32)
    reach = np.maximum.accumulate(wide)
    base = (doc != np.roll(doc, 1)).cumsum().astype(np.int64) * (1 << 32)
    new = np.concatenate([[True], (start + base)[1:] > reach[:-1]])
    new[1:] |= doc[1:] != doc[:-1]
    first, _ = common.runs(new)
    out = np.zeros(len(first), _SPAN)
    out["doc"], out["start"] = doc[first], start[first]
    out["end"] = np.maximum.reduceat(end, first)
    return out


def _read(table: pa.Table, kind: int, dtype) -> np.ndarray:
    parts = [np.frombuffer(b, dtype) for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist()) if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


_ASK = "doc long, start int, end int, anchor long, n int, at int, hot int"
_ASKED = ("doc", "start", "end", "anchor", "n", "at", "hot")


def _meet_runs(table: pa.Table, window: int) -> pa.Table:
    """Spans of runs that are equal elsewhere; one run of each value, to be read, where an anchor has different ones."""
    run, spans = _read(table, RUNS, _RUN), [_read(table, SPANS, _SPAN)]
    opened = np.zeros(0, _RUN)
    hot = np.zeros(0, np.int32)
    if len(run):
        again, one = _repeated(common.mix(run["anchor"] + run["digest"] * common.BASE), run["doc"], run["start"])
        spans.append(_as_spans(run[again], window))
        one = run[one]
        one = one[np.argsort(one["anchor"], kind="stable")]
        _, inverse, count = np.unique(one["anchor"], return_inverse=True, return_counts=True)
        opened, hot = one[count[inverse] > 1], (count[inverse][count[inverse] > 1] > SCAN).astype(np.int32)
    spans = np.concatenate(spans)
    none = np.zeros(len(spans), np.int32)
    return pa.table({
        "doc": np.concatenate([spans["doc"], opened["doc"]]), "start": np.concatenate([spans["start"], opened["start"]]),
        "end": np.concatenate([spans["end"], opened["start"] + opened["n"] + window - 1]),
        "anchor": np.concatenate([none.astype(np.int64), np.ascontiguousarray(opened["anchor"]).view(np.int64)]),
        "n": np.concatenate([none, opened["n"]]), "at": np.concatenate([none, opened["at"]]), "hot": np.concatenate([none - 1, hot])})


def interval_tree(prefixes: np.ndarray):
    """Intervals (common prefix, first, last) of a sorted suffix list, innermost first, by a scan with a stack.

    ``prefixes[k]`` is the common prefix of suffixes k and k + 1.
    """
    stack = [(0, 0)]  # (common prefix, first suffix)
    for k, common_prefix in enumerate([*prefixes.tolist(), -1]):
        first = k
        while stack and stack[-1][0] > common_prefix:
            length, first = stack.pop()
            if k > first:
                yield length, first, k
        if common_prefix >= 0 and (not stack or stack[-1][0] < common_prefix):
            stack.append((common_prefix, first))


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix of consecutive rows of bytes, no longer than either."""
    differ = rows[:-1] != rows[1:]
    found = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(found, np.minimum(sizes[:-1], sizes[1:]))


def maximal_repeats(befores: list[bytes], afters: list[bytes], window: int):
    """Maximal repeats of at least ``window`` bytes across a common place of several strings, given what stands before
    and after it: (bytes before, bytes after, members), where each member's string holds the repeat.

    ``bytes before`` may differ among members; it is a list like ``members``, the longest that each shares with another.
    """
    m = len(afters)

    def matrix(strings):
        width = max(1, max(map(len, strings)))
        return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(m, width), np.array([len(s) for s in strings])

    right, right_size = matrix(afters)
    left, left_size = matrix([b[::-1] for b in befores])
    order = np.lexsort((right_size, np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel()))
    by_left = np.lexsort((left_size, np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel()))
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    for length, first, last in interval_tree(_common(right[order], right_size[order])):
        members = order[first:last + 1]
        members = members[np.argsort(rank[members], kind="stable")]
        shared = _common(left[members], left_size[members])
        # Left extensions are diverse where neighbours share less than the window needs: there the group parts.
        linked = shared + length >= window
        if linked.any():
            own = np.maximum(np.concatenate([[0], np.where(linked, shared, 0)]), np.concatenate([np.where(linked, shared, 0), [0]]))
            part = np.concatenate([[True], ~linked])
            begin, sizes = common.runs(part)
            for a, n in zip(begin.tolist(), sizes.tolist()):
                if n > 1:
                    yield own[a:a + n], length, members[a:a + n]


def _settle(table: pa.Table, window: int) -> pa.Table:
    """Spans of what is repeated among the runs and window digests of one bucket; known spans pass through."""
    spans = [_read(table, SPANS, _SPAN)]
    seen = _read(table, WINDOWS, _WINDOW)
    if len(seen):
        again, _ = _repeated(seen["digest"], seen["doc"], seen["start"])
        found = np.sort(seen[again], order=["doc", "start"])
        spans.append(_joined(found["doc"], found["start"], found["start"] + window))
    groups: dict[int, list] = {}
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
        if kind == RUNS:
            at = 0
            while at < len(blob):
                row = np.frombuffer(blob, _OPEN, 1, at)[0]
                size = int(row["n"]) + window - 1
                at += _OPEN.itemsize
                groups.setdefault(int(row["anchor"]), []).append((int(row["doc"]), int(row["start"]), int(row["at"]), blob[at:at + size]))
                at += size
    out = []
    for members in groups.values():
        members.sort()
        if len(members) < 2:
            continue
        for before, after, rows in maximal_repeats([b[:at] for *_, at, b in members], [b[at:] for *_, at, b in members], window):
            for size, k in zip(before.tolist(), rows.tolist()):
                doc, start, at, _ = members[k]
                out.append((doc, start + at - size, start + at + after))
    found = np.array(sorted(out), _SPAN) if out else np.zeros(0, _SPAN)
    spans.append(_joined(found["doc"], found["start"], found["end"]))
    spans = np.concatenate(spans)
    common.give_back()
    return pa.table({n: spans[n] for n in _SPAN.names})


def repeated_spans(docs: DataFrame, window: int, text: str, doc_id: str, size: int, groups: int) -> DataFrame:
    """``doc, start, end`` of all bytes that some window covers which also starts elsewhere; ``doc`` is the ``KEY`` of the rows."""
    gram = max(1, window * 2 // 5)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, size // max(1, (window - gram) // 2) // PER_BUCKET)
    later = max(partitions, size >> 26)
    asked = _runs(docs, window, gram, buckets, text).groupBy("bucket").applyInArrow(lambda t: _meet_runs(t, window), _ASK)

    def read(texts: pa.Table, about: pa.Table) -> pa.Table:
        columns = [about[c].to_numpy() for c in _ASKED]
        doc, start, end, anchor, n, at, hot = columns
        known = hot < 0
        rows = []
        if known.any():
            spans = np.zeros(int(known.sum()), _SPAN)
            spans["doc"], spans["start"], spans["end"] = doc[known], start[known], end[known]
            rows.append((int(spans["doc"][0]) % later, SPANS, spans.tobytes()))
        mine: dict[int, list[int]] = {}
        for k in np.flatnonzero(~known).tolist():
            mine.setdefault(int(doc[k]), []).append(k)
        texts = texts.combine_chunks()
        ids = texts[KEY].to_pylist()
        offsets, data = common.utf8(texts[text].combine_chunks())
        parts: dict[int, list[bytes]] = {}
        windows = []
        for k, name in enumerate(ids):
            raw = data[offsets[k]:offsets[k + 1]]
            wanted = [j for j in mine.pop(name, ()) if end[j] <= len(raw)]
            if wanted and hot[wanted].any():
                sums, inverse = _sums(raw)
                for j in wanted:
                    if hot[j]:
                        places = np.arange(start[j], start[j] + n[j])
                        made = np.zeros(len(places), _WINDOW)
                        made["digest"], made["doc"], made["start"] = _range_digest(sums, inverse, places, places + window), name, places
                        windows.append(made)
            for j in wanted:
                if not hot[j]:
                    row = np.array([(int(anchor[j]) % (1 << 64), name, start[j], n[j], at[j], 0)], _OPEN)
                    parts.setdefault(int(row["anchor"][0] % np.uint64(later)), []).append(row.tobytes() + raw[start[j]:end[j]].tobytes())
        rows += [(b, RUNS, b"".join(p)) for b, p in parts.items()]
        if windows:
            seen = np.concatenate(windows)
            again, one = _repeated(seen["digest"], seen["doc"], seen["start"])
            found = np.sort(seen[again], order=["doc", "start"])
            if len(found):
                spans = _joined(found["doc"], found["start"], found["start"] + window)
                rows.append((int(spans["doc"][0]) % later, SPANS, spans.tobytes()))
            one = seen[one]
            rows += [(b, WINDOWS, blob) for b, blob in _by_bucket((one["digest"] % np.uint64(later)).astype(np.int64), one)]
        return _batch(rows)

    met = common.meet(docs.select(*dict.fromkeys([doc_id, text, KEY])), KEY, asked, "doc", groups, read, BLOBS)
    return met.groupBy("bucket").applyInArrow(lambda t: _settle(t, window), "doc long, start int, end int")


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
          T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]


def remove_repeats(docs: DataFrame, window: int = 400, text: str = "text", doc_id: str = "doc_id", kept: bool = True) -> DataFrame:
    """Every row with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and the ``kept`` bytes.

    A byte of the UTF-8 text is removed if a string of ``window`` bytes that covers it also starts anywhere else, in the
    same text too; overlaps count, matches never cross texts, and strings are judged on the input. A null or empty text
    has no bytes. Rows of equal id (or both of none) and equal text are one document, not copies of each other; rows
    that differ in id or text are different documents. New columns replace those of their names, all others pass through.
    """
    rows, size = common.volume(docs, text)
    groups = max(1, size // PER_GROUP, rows // 20_000)
    fields = FIELDS if kept else FIELDS[:4]
    keep = [c for c in docs.columns if c not in {f.name for f in fields}]
    docs = docs.select(*keep, F.xxhash64(doc_id, text).alias(KEY))

    def cut(texts: pa.Table, about: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        doc, start, end = (about[c].to_numpy() for c in _SPAN.names)
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
        ids = texts[KEY].to_numpy()
        column = texts[text]
        offsets, data = common.utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        columns: list[list] = [[], [], [], [], []]
        low, high = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        for k in range(len(ids)):
            raw = data[offsets[k]:offsets[k + 1]]
            left, removed, spans = raw, 0, 0
            if high[k] > low[k]:
                gone = common.covered(start[low[k]:high[k]], end[low[k]:high[k]], len(raw))
                left, removed = raw[~gone], int(gone.sum())
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            left = left.tobytes()
            for values, value in zip(columns, (len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left)):
                values.append(value)
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))][:len(fields)]
        return pa.Table.from_arrays([texts[c] for c in keep] + made, names=keep + [f.name for f in fields])

    spans = repeated_spans(docs, window, text, doc_id, size, groups)
    return common.meet(docs, KEY, spans, "doc", groups, cut, T.StructType([docs.schema[c] for c in keep] + fields))
