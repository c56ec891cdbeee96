"""Ranked lexical search by presence masks.

A shard of documents keeps, for each term, one bitmap over its documents and a posting of impacts. For an item the bitmaps of its terms
are transposed into one mask a document, which tells the terms it holds; documents of equal mask form a group. The terms'
greatest impacts in the shard bound what a mask can score, and masks are evaluated in descending order of that bound
until the k-th best exact score is above the next one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.scale import top_per_group
from tidemark.llm import common

SHARD = 32_768  # documents of one shard
TERMS = 1_000_000  # terms of the items that are searched in one pass over the documents
CHUNK = 128  # documents that are scored between two looks at the bound, at least

#: Bytes that are no part of a term: all of ASCII but digits and letters.
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(texts: pa.Array):
    """For slices of the texts: first row, hashes of all terms, their first bytes and ends, number of each text's first term, bytes in lower case."""
    offsets, data = common.utf8(texts)
    for first, last in common.slices(offsets):
        part = _LOWER[data[offsets[first]:offsets[last]]]
        hashes, starts, ends, bounds = common.words(offsets[first:last + 1] - offsets[first], part, space=_NO_TERM)
        yield first, hashes, starts, ends, bounds, part


def _term(part: np.ndarray, start: int, end: int) -> bytes:
    return part[start:end].tobytes()


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, terms``: the distinct terms of each row."""
    schema = items.select(F.col(item_id).alias("item")).schema.add("terms", T.ArrayType(T.BinaryType()))

    def task(batches):
        for batch in batches:
            found = []
            for _, _, starts, ends, bounds, part in terms_of(batch.column(1)):
                for a, b in zip(bounds[:-1], bounds[1:]):
                    found.append(sorted({_term(part, starts[i], ends[i]) for i in range(a, b)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=schema.names)

    return items.select(F.col(item_id).alias("item"), text).mapInArrow(task, schema)


class Vocabulary:
    """Terms in byte order, found by hash and confirmed byte for byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = pa.array(terms, pa.binary())
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        # The offsets are texts of one term each.
        hashes = common.words(offsets, data, space=_NO_TERM)[0]
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among the given terms, and number in the vocabulary, of those it holds."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == hashes)
        number = self.order[at[hit]]
        # Equal hashes of different terms, should they ever meet, are told apart here.
        sizes = ends[hit] - starts[hit]
        bytes_ = part[common.within(starts[hit], sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
        same = pc.equal(words, self.terms.take(pa.array(number))).to_numpy(zero_copy_only=False)
        return hit[same], number[same]


def matched(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, hits``: number of all terms, and the vocabulary's terms in the text as numbers and counts (32 bits each).

    ``vocabulary`` is a broadcast ``Vocabulary``.
    """
    def task(batches):
        words = vocabulary.value
        for batch in batches:
            lengths, hits = [], []
            for _, hashes, starts, ends, bounds, part in terms_of(batch.column(1)):
                lengths += np.diff(bounds).tolist()
                hit, number = words.find(hashes, starts, ends, part)
                row = np.searchsorted(bounds, hit, "right") - 1
                pairs, counts = np.unique(row << 32 | number, return_counts=True)
                cut = np.searchsorted(pairs, np.arange(len(bounds)) << 32)
                numbers, counts = (pairs & 0xFFFFFFFF).astype("<u4"), counts.astype("<u4")
                hits += [numbers[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(hits, pa.binary())], names=["doc_id", "n", "hits"])
        common.give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(task, "doc_id long, n long, hits binary")


def _unpack(hits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of all hits."""
    sizes = np.array([len(h) // 8 for h in hits], np.int64)
    flat = np.frombuffer(b"".join(hits), "<u4")
    ends = np.cumsum(2 * sizes)
    term = common.within(ends - 2 * sizes, sizes)
    return np.repeat(np.arange(len(hits)), sizes), flat[term], flat[term + np.repeat(sizes, sizes)]


def _frequencies(hits: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; counted in the tasks before anything moves."""
    def task(batches):
        total: dict[int, int] = {}
        for batch in batches:
            numbers, counts = np.unique(_unpack(batch.column(0).to_pylist())[1], return_counts=True)
            for number, count in zip(numbers.tolist(), counts.tolist()):
                total[number] = total.get(number, 0) + count
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["term", "n"])

    df = np.zeros(terms, np.int64)
    for r in hits.select("hits").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return df


class Shard:
    """Bitmaps and impact postings of some documents; rows are numbered in the order given."""

    def __init__(self, hits: list[bytes], damped: np.ndarray):
        """``damped`` is m of each document."""
        self.rows = len(hits)
        row, term, count = _unpack(hits)
        impact = (1_000_000_000 * count.astype(np.int64)) // (1000 * count.astype(np.int64) + 20 * damped[row])
        order = np.argsort(term, kind="stable")
        row, term, impact = row[order].astype(np.int32), term[order], impact[order]
        first, sizes = common.runs(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else ([], [])
        self.posted = {int(term[f]): (row[f:f + n], impact[f:f + n], int(impact[f:f + n].max())) for f, n in zip(first, sizes)}
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        if term not in self.bitmaps:
            flags = np.zeros(-(-self.rows // 64) * 64, bool)
            flags[self.posted[term][0]] = True
            self.bitmaps[term] = np.packbits(flags)
        return self.bitmaps[term]

    def masks(self, terms: list[int]) -> np.ndarray:
        """Mask bytes by document, eight terms a byte: the terms' bitmaps turned over."""
        flags = np.unpackbits(np.array([self.bitmap(t) for t in terms]), axis=1)[:, :self.rows]
        return np.ascontiguousarray(np.packbits(flags, axis=0).T)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best documents that score above 0, lower rows first among equals."""
        known = [(t, w) for t, w in zip(terms.tolist(), weights.tolist()) if w > 0 and t in self.posted]
        none = np.zeros(0, np.int64)
        if not known:
            return none, none
        masks = self.masks([t for t, _ in known])
        group = np.zeros(self.rows, np.int64)
        for k8 in range(0, masks.shape[1], 8):  # eight bytes at a time: documents of one group have equal masks so far
            eight = np.zeros((self.rows, 8), np.uint8)
            eight[:, :masks.shape[1] - k8] = masks[:, k8:k8 + 8]
            value, number = np.unique(eight.view(np.uint64).ravel(), return_inverse=True)
            group = number if k8 == 0 else np.unique(group * len(value) + number, return_inverse=True)[1]
        by_group = np.argsort(group, kind="stable")
        starts, sizes = common.runs(np.concatenate([[True], np.diff(group[by_group]) != 0]))
        most = np.array([w * self.posted[t][2] for t, w in known] + [0] * (-len(known) % 8), np.int64).reshape(-1, 8)
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) @ most.T
        bound = sum(table[masks[by_group[starts], b], b] for b in range(masks.shape[1]))
        best = np.argsort(-bound, kind="stable")
        best = best[bound[best] > 0]
        rows, scores, done, chunk = none, none, 0, max(CHUNK, 2 * k)
        while done < len(best):
            if len(scores) >= k and bound[best[done]] < scores[k - 1]:
                break
            upto = done + 1 + int(np.searchsorted(np.cumsum(sizes[best[done:done + chunk]]), chunk))
            some = best[done:upto]
            more = np.sort(by_group[common.within(starts[some], sizes[some])])
            rows, scores = np.concatenate([rows, more]), np.concatenate([scores, self._scores(more, known)])
            order = np.lexsort((rows, -scores))
            order = order[scores[order] > 0][:k]
            rows, scores, done, chunk = rows[order], scores[order], upto, 2 * chunk
        return rows, scores

    def _scores(self, rows: np.ndarray, known: list[tuple[int, int]]) -> np.ndarray:
        total = np.zeros(len(rows), np.int64)
        for term, weight in known:
            holders, impacts, _ = self.posted[term]
            at = np.minimum(np.searchsorted(holders, rows), len(holders) - 1)
            total += np.where(holders[at] == rows, weight * impacts[at], 0)
        return total


def _search(hits: DataFrame, items: list[tuple], weights: np.ndarray, totals: tuple[int, int], k: int, shard: int, item_type) -> DataFrame:
    """The k best documents of every shard for each item ``(id, term numbers)``."""
    spark = hits.sparkSession
    n_docs, n_terms = totals
    shards = max(1, -(-n_docs // shard))
    shipped = spark.sparkContext.broadcast((items, weights))
    schema = "place int, doc_id long, score long"

    def rank(table: pa.Table) -> pa.Table:
        asked, w = shipped.value
        # Rows in the order of their ids, a null id last.
        table = table.sort_by([("doc_id", "ascending")])
        lengths, number = np.unique(table["n"].to_numpy(), return_inverse=True)
        damped = np.array([50 + 50 * int(n) * n_docs // n_terms for n in lengths], np.int64)
        index = Shard(table["hits"].to_pylist(), damped[number])
        ids = table["doc_id"].combine_chunks()
        places, rows, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, (_, terms) in enumerate(asked):
            found, score = index.top(terms, w[terms], k)
            places += [place] * len(found)
            rows.append(found)
            scores.append(score)
        common.give_back()
        return pa.table({"place": pa.array(places, pa.int32()), "doc_id": ids.take(pa.array(np.concatenate(rows))), "score": np.concatenate(scores)})

    # Shards take turns with the stored rows, so no id or text makes one larger than the others.
    dealt = hits.filter("octet_length(hits) > 0").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(rank, schema)
    names = spark.createDataFrame([(place, item) for place, (item, _) in enumerate(items)], item_type)
    return found.join(names, "place").select("item_id", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
         item_id: str = "item_id", shard: int = SHARD, terms: int = TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents of highest score above 0, ties to the smaller id.

    Terms are maximal runs of digits, ASCII letters and all characters beyond ASCII, with A-Z lower-cased. An item's
    score of a document adds, over its distinct terms, the weight floor(1000 ln((2N + 2) / (2df + 1))) times
    10**9 tf div (1000 tf + 20 m), with m = 50 + 50 n N div L; N counts documents with a term, L their terms. All
    documents count and are candidates. Items whose terms together exceed ``terms`` are searched in several passes by
    the hash of their id, so that what a pass sends to the tasks keeps its size; a single item is never cut.

    A null or empty text has no terms: as a document it is never found, as an item it finds none. Rows that repeat an item's id are
    one item with the terms of all. Rows that repeat a document's id are documents of their own, equal scores among them in any
    order; a document without an id comes last among equals. Other columns take no part; without documents or items
    there are no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    asked = common.scratch(_item_terms(items, item_id, item_text), "items")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-size // terms))
    item_type = asked.schema["item"].dataType
    schema = asked.select(F.lit(0).alias("place"), F.col("item").alias("item_id")).schema
    parts = []
    for number in range(passes):
        here = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect()
        grouped: dict = {}
        for r in here:
            grouped.setdefault(r["item"], set()).update(bytes(t) for t in r["terms"])
        words = sorted(set().union(*grouped.values()))
        if not words:
            continue
        numbers = {t: i for i, t in enumerate(words)}
        wanted = [(item, np.array(sorted(numbers[t] for t in found), np.int64)) for item, found in grouped.items() if found]
        hits = common.scratch(matched(docs, spark.sparkContext.broadcast(Vocabulary(words)), doc_id, text), "matched")
        n_docs, n_terms = hits.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        df = _frequencies(hits, len(words))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = _search(hits, wanted, weights, (n_docs, n_terms), k, shard, schema)
        parts.append(found if passes == 1 else common.scratch(found, "found"))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    best = top_per_group(found, "item_id", [F.desc("score"), F.asc_nulls_last("doc_id")], k, ["doc_id"], rank="rank")
    return best.select("item_id", "rank", "doc_id", "score")
