"""Language identification by prediction by partial matching: one byte context tree per language.

Contexts have up to three bytes. A symbol that a context has seen costs -log2(count / (total + distinct)) bits; else
the escape costs -log2(distinct / (total + distinct)) bits and the next shorter context decides, down to eight bits
for a byte no context has seen. Statistics are frozen after ``fit``, so a code length depends on the text alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm import common

NONE = "und"


@dataclass
class LanguageModel:
    """Counts of all trained (three byte context, byte) pairs, per language; symbols are numbered from 1, 0 is the text's start."""

    langs: list[str]
    symbol: np.ndarray  # of each byte; unseen bytes share the last number
    size: int
    codes: list[np.ndarray]
    counts: list[np.ndarray]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each three symbol context, and code lengths in bits by row, symbol and language."""
        size, langs = self.size, len(self.langs)
        seen = np.unique(np.concatenate([c // size for c in self.codes]))
        kept = [np.unique(seen % size**order) for order in range(4)]
        base = np.cumsum([0, *map(len, kept)])
        table = np.full((base[-1], size, langs), 8, np.float32)
        row = np.zeros(size**3, np.int32)
        for order, known in enumerate(kept):
            here = table[base[order]:base[order + 1]]
            if order:
                parent = base[order - 1] + np.searchsorted(kept[order - 1], known % size ** (order - 1))
                for k in range(0, len(known), 4096):
                    here[k:k + 4096] = table[parent[k:k + 4096]]
            for lang, (codes, counts) in enumerate(zip(self.codes, self.counts)):
                cell, place = np.unique(codes % size ** (order + 1), return_inverse=True)
                count = np.bincount(place, counts)
                at = np.searchsorted(known, cell // size)
                total, distinct = np.bincount(at, count, len(known)), np.bincount(at, minlength=len(known))
                used = np.flatnonzero(total)
                escape = -np.log2(distinct[used] / (total[used] + distinct[used]))
                here[used, :, lang] += escape[:, None].astype(np.float32)
                here[at, cell % size, lang] = -np.log2(count / (total[at] + distinct[at]))
            # All three symbol contexts that end with a known one; longer known ones overwrite them later.
            row.reshape(-1, size**order)[:, known] = base[order] + np.arange(len(known), dtype=np.int32)
        return row, table.reshape(-1, langs)


def contexts(starts: np.ndarray, symbols: np.ndarray, size: int) -> np.ndarray:
    """The three symbols before each position as one number, never across the start of a text."""
    code = np.zeros_like(symbols)
    before = symbols
    for factor in (1, size, size * size):
        before = np.concatenate([before[:1], before[:-1]])
        before[starts] = 0
        code += before * symbols.dtype.type(factor)
    return code


def _drawn(docs: DataFrame, text: str, lang: str, doc_id: str, rows_per_lang: int, bytes_per_lang: int) -> list:
    """``lang, text`` of the rows that ``fit`` learns from."""
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")) \
        .filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.octet_length("text") > 0))
    # Not negative; the highest bit in use tells a text that alone exceeds the sample.
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(10)), 2) + F.when(F.octet_length("text") > bytes_per_lang, 2**62).otherwise(0)
    labelled = labelled.withColumn("draw", draw).withColumn("range", F.shiftright("draw", 52))
    # Ranges of the draw are counted first; their bounds, one a language, go into the plan, so no text moves but those drawn.
    earlier = F.sum("count").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bounds = (labelled.groupBy("lang", "range").count().withColumn("earlier", F.coalesce(earlier, F.lit(0)))
              .filter(F.col("earlier") < rows_per_lang).groupBy("lang").agg(F.max("range").alias("range")).collect())
    if not bounds:
        return []
    known = F.create_map(*[F.lit(x) for r in bounds for x in (r["lang"], r["range"])])
    near = labelled.filter(F.col("range") <= known[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("draw", "id", "text")
    placed = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows_per_lang)
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < bytes_per_lang)
            .orderBy("lang", "place").select("lang", "text").collect())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        rows_per_lang: int = 150, bytes_per_lang: int = 1_000_000) -> LanguageModel:
    """Learn from a bounded sample of labelled rows: per language at most ``rows_per_lang`` whole texts, in the order of
    the id's hash, until ``bytes_per_lang`` bytes are reached; texts longer than that come after all others. Rows with a null or empty text, a null label or
    a null id are not used and count for nothing. Without labelled rows the model knows no language."""
    picked = _drawn(docs, text, lang, doc_id, rows_per_lang, bytes_per_lang)
    if not picked:
        return LanguageModel([], np.zeros(256, np.int64), 2, [], [])
    taken: dict[str, list[bytes]] = {}
    for r in picked:
        taken.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "replace"))
    langs = sorted(taken)
    known = np.unique(np.frombuffer(b"".join(b"".join(v) for v in taken.values()), np.uint8))
    symbol = np.full(256, len(known) + 1, np.int64)
    symbol[known] = np.arange(1, len(known) + 1)
    size = len(known) + 2
    codes, counts = [], []
    for name in langs:
        starts = np.cumsum([0, *map(len, taken[name][:-1])])
        s = symbol[np.frombuffer(b"".join(taken[name]), np.uint8)]
        pair, n = np.unique(contexts(starts, s, size) * size + s, return_counts=True)
        codes.append(pair)
        counts.append(n)
    return LanguageModel(langs, symbol, size, codes, counts)


def scorer(model: LanguageModel) -> Callable[[pa.Array], tuple[pa.Array, pa.Array, pa.Array]]:
    """A function from texts to predicted language, probability and bits a byte."""
    row, bits = model.tables() if model.langs else (None, None)
    langs = np.array(model.langs + [NONE], object)
    symbol = model.symbol.astype(np.int32)

    def score(texts: pa.Array):
        offsets, data = common.utf8(texts)
        rows = len(texts)
        best, sure, rate = np.full(rows, len(model.langs)), np.zeros(rows), np.full(rows, np.nan)
        for first, last in common.slices(offsets, common.SLICE_BYTES // 4):
            part = data[offsets[first]:offsets[last]]
            local = offsets[first:last] - offsets[first]
            sizes = np.diff(offsets[first:last + 1])
            full = np.flatnonzero(sizes)
            if not len(full) or not model.langs:
                continue
            starts = local[full]
            symbols = symbol[part]
            cell = row[contexts(starts, symbols, model.size)].astype(np.int64) * model.size + symbols
            lengths = np.add.reduceat(bits[cell], starts, axis=0, dtype=np.float64)
            letter = np.add.reduceat(_LETTER[part], starts, dtype=np.int64) > 0
            for k in np.flatnonzero(~letter):
                letter[k] = any(map(str.isalpha, bytes(part[starts[k]:starts[k] + sizes[full[k]]]).decode("utf-8", "replace")))
            pick = lengths.argmin(1)
            least = lengths[np.arange(len(full)), pick]
            where = first + full[letter]
            best[where] = pick[letter]
            sure[where] = (1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1))[letter]
            rate[where] = (least / sizes[full])[letter]
        return pa.array(langs[best], pa.string()), pa.array(sure, pa.float64()), pa.array(rate, pa.float64(), from_pandas=True)

    return score


_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1

#: Bits a byte of a text that no tree can shorten, and bits that a text may cost besides: its start, which no context
#: foretells, and a value such as a token, which alone can outweigh the words of a short text.
RAW_BITS, FREE_BITS = 8, 512


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("bits_per_byte", T.DoubleType())]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (probability of that language) and ``bits_per_byte`` of its best tree.

    Whole texts are scored in the order of their bytes. A null or empty text and one without a letter give ``und``,
    score 0 and null bits; equal code lengths go to the first language by name. Columns of these names are replaced,
    all others pass through; repeated rows get equal results.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return common.append(docs, [text], FIELDS, lambda: scorer(shipped.value))
