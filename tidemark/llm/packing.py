"""Packing of tokenised documents into sequences of fixed length, online and in bounded space.

Each task keeps ``open_windows`` sequences open. What is left of a document after its full sequences goes to the open
sequence with the least room that holds it. If none holds it and no further may be opened, the fullest one is topped up
by a cut of the piece and emitted without padding. Leftover open sequences, a bounded number a task, are merged in
groups of tasks by the same rule; the last one of each group is cut into sequences of a power of two each.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "task long, ids binary")
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
TYPES = [pa.binary() if " binary" in part else pa.int64() for part in SCHEMA.split(", ")]
#: Sequence ids: 31 bits for the number within a task below the task; merged leftovers lie above all tasks.
PER_TASK, MERGED = 1 << 31, 1 << 62


class Packer:
    """Open sequences of one task. A piece is (doc_id, start, ids as little-endian 32-bit numbers, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next = window, open_windows, first_id
        self.open: list[list] = []  # [room, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list, task: int | None = None) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, task, ids if task is not None else None))
            offset += n
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size = 4 * self.window
        while len(ids) >= size:
            self.emit([(doc, start, ids[:size], total)])
            start, ids = start + self.window, ids[size:]
        while ids:
            n = len(ids) // 4
            fit = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.most:
                fit = [self.window, []]
                self.open.append(fit)
            if fit is None:
                fit = min(self.open, key=lambda w: w[0])
                n = fit[0]
            fit[0] -= n
            fit[1].append((doc, start, ids[:4 * n], total))
            start, ids = start + n, ids[4 * n:]
            if not fit[0]:
                self.open.remove(fit)
                self.emit(fit[1])

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], names=NAMES)


_LOADED: dict = {}
#: Characters that both libraries class alike whatever their Unicode version; other texts go to the slower one.
_PLAIN = re.compile("[^\\t\\n\\r -~\u00a1-\u024f\u2010-\u2027]")


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (n for n in range(256, 512))
    return {chr(b if b in printable else next(spare)): b for b in range(256)}


def tokenizer(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit numbers, made once per worker.

    The vocabulary's merges are run by ``tiktoken``, several times as fast, where ids follow the order of the merges and
    the text holds only plain characters and no special token; else by ``tokenizers``.
    """
    if path not in _LOADED:
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        loaded = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec.get("added_tokens", ())]
        order, byte_of = spec["model"]["vocab"], _byte_characters()
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        fast = None
        if all(order.get(m) == 256 + k for k, m in enumerate(merges)) and spec["pre_tokenizer"]["type"] == "ByteLevel" \
                and not spec["pre_tokenizer"]["add_prefix_space"] and not spec.get("normalizer"):
            ranks = {bytes(byte_of[c] for c in piece): n for piece, n in order.items() if piece not in special}
            fast = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        del spec, order, merges

        def encode(text: str) -> bytes:
            if fast and not _PLAIN.search(text) and not any(t in text for t in special):
                return np.array(fast.encode_ordinary(text), "<u4").tobytes()
            return np.array(loaded.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        _LOADED[path] = encode
    return _LOADED[path]


# Fixed pattern of byte-level pre-tokenising.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, text: str = "text",
         doc_id: str = "doc_id", open_windows: int = 32, merge_tasks: int = 64) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` that cover every document once.

    A null or empty text is the end id alone. Equal ids and repeated rows are packed as documents of their own, a null
    id is carried as null; an empty table gives no rows. Other columns take no part.
    """
    end = np.array([end_id], "<u4").tobytes()

    def task(batches):
        encode = tokenizer(tokenizer_path)
        here = TaskContext.get().partitionId()
        packer = Packer(window, open_windows, here * PER_TASK)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                encoded = encode(texts[k].as_py() or "") + end
                packer.add(ids[k].as_py(), 0, encoded, len(encoded) // 4)
                if len(packer.rows) >= 4096:
                    yield packer.take()
        for _, pieces in packer.open:
            packer.emit(pieces, task=here)
        yield packer.take()
        common.give_back()

    def merge(key, table):
        group = key[0].as_py()
        packer = Packer(window, open_windows, MERGED + group * PER_TASK)
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows = [c.to_pylist() for c in table.select(["doc_id", "start", "ids", "doc_tokens"]).columns]
        for piece in zip(*rows):
            packer.add(*piece)
        rest = [p for _, pieces in packer.open for p in pieces]
        last = Packer(window, 1, packer.next)
        for piece in rest:
            last.add(*piece)
        packer.rows += last.rows
        packer.next = last.next
        for _, pieces in last.open:
            left = sum(len(p[2]) // 4 for p in pieces)
            while left:
                power = 1 << (left.bit_length() - 1)
                taken, need = [], power
                while need:
                    doc, start, ids, total = pieces.pop(0)
                    n = min(need, len(ids) // 4)
                    taken.append((doc, start, ids[:4 * n], total))
                    if 4 * n < len(ids):
                        pieces.insert(0, (doc, start + n, ids[4 * n:], total))
                    need -= n
                packer.emit(taken)
                left -= power
        return pa.Table.from_batches([packer.take()])

    common.small_batches(docs.sparkSession)
    # Written once: the closed pieces and the leftovers are both read from it.
    packed = common.scratch(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(task, SCHEMA), "packed")
    merged = (packed.filter(F.col("task").isNotNull()).withColumn("group", F.floor(F.col("task") / merge_tasks))
              .groupBy("group").applyInArrow(merge, SCHEMA))
    return packed.filter(F.col("task").isNull()).unionByName(merged).drop("task", "ids")
