"""SentencePiece (BPE) encoding with source offsets, and decoding, from the model file alone.

Normalisation takes the longest prefix that the compiled character map knows and records, for every normalised byte,
where its source began. Pieces are merged by score as the library does, and each piece is projected through that record
to the span of original bytes it stands for.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tidemark.llm import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(blob: bytes):
    """(number, value) of each field of a protocol buffer message."""
    def varint(i):
        value = shift = 0
        while True:
            value |= (blob[i] & 127) << shift
            shift += 7
            i += 1
            if blob[i - 1] < 128:
                return value, i
    i = 0
    while i < len(blob):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ((8, 4)[kind == 5], i)
            value, i = blob[i:i + n], i + n
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over source prefixes and the pool of their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.pool = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix at a place, and what replaces it; length 0 if none is known."""
        units, node, best = self.units, 0, (0, b"")
        if not units:
            return best
        node ^= (units[0] >> 10) << ((units[0] & (1 << 9)) >> 6)
        for place in range(at, len(text)):
            node ^= text[place]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[place]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = place + 1 - at, self.pool[start:self.pool.index(b"\0", start)]
        return best


@dataclass
class PieceModel:
    """What encoding needs of a BPE model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    chars: CharMap
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True
    byte_fallback: bool = False
    unknown: int = 0
    surface: str = " ⁇ "
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        model = cls([], [], [], CharMap(b""))
        model.byte_ids = [0] * 256
        with open(path, "rb") as file:
            blob = file.read()
        kind_of_model = 1
        for number, value in _fields(blob):
            if number == 1:
                part = dict(_fields(value))
                model.pieces.append(part[1].decode())
                model.scores.append(float(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0]))
                model.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                part = dict(_fields(value))
                kind_of_model = part.get(3, 1)
                model.byte_fallback = bool(part.get(35, 0))
                model.surface = part.get(44, model.surface.encode()).decode()
            elif number == 3:
                part = dict(_fields(value))
                model.chars = CharMap(part.get(2, b""))
                model.dummy_prefix, model.collapse, model.escape = (bool(part.get(n, 1)) for n in (3, 4, 5))
        if kind_of_model != 2:
            raise ValueError("only BPE models are supported")
        for number, (piece, kind) in enumerate(zip(model.pieces, model.kinds)):
            if kind in (NORMAL, USER, UNUSED):
                model.ids[piece] = number
            elif kind == UNKNOWN:
                model.unknown = number
            elif kind == BYTE:
                model.byte_ids[int(piece[3:5], 16)] = number
        if any(k == USER for k in model.kinds):
            raise ValueError("models with user-defined symbols are not supported")
        return model

    @functools.cached_property
    def splits(self) -> bool:
        """True if no piece holds a space mark after another character, so that no merge crosses the start of a word."""
        return self.escape and not self.collapse and not self.chars.units and not any(
            re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Normalised text, and the first source byte and source end that each of its bytes stands for."""
        raw = text.encode("utf-8", "replace")
        mark = SPACE.encode() if self.escape else b" "
        chunks: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(raw):
            n, new = self.chars.longest(raw, at)
            if not n:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                new = raw[at:at + n]
            chunks.append((new, at, at + n))
            at += n
        if self.collapse:  # no white space at the ends, single spaces between
            while chunks and chunks[0][0] in (b"", b" "):
                chunks.pop(0)
        out, starts, ends = [], [], []

        def put(new: bytes, start: int, end: int) -> None:
            out.append(new)
            starts.extend([start] * len(new))
            ends.extend([end] * len(new))

        if chunks and self.dummy_prefix:
            put(mark, chunks[0][1], chunks[0][1])
        after_space = self.collapse
        for new, start, end in chunks:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = self.collapse and new.endswith(b" ")
                put(new.replace(b" ", mark), start, end)
        joined = b"".join(out)
        while self.collapse and joined.endswith(mark):
            joined = joined[:-len(mark)]
        return joined.decode("utf-8", "replace"), np.array(starts[:len(joined)], np.int64), np.array(ends[:len(joined)], np.int64)

    @functools.cached_property
    def kinds_used(self) -> set[int]:
        return set(self.kinds)

    def merge(self, normal: str) -> list[str]:
        """Symbols after merging, by highest score, leftmost first among equals."""
        symbols: list[str] = list(normal)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ids, scores, heap = self.ids, self.scores, []
        halves: dict[str, tuple[str, str]] = {}

        def offer(left: int, right: int) -> None:
            if left < 0 or right >= n:
                return
            made = symbols[left] + symbols[right]
            number = ids.get(made)
            if number is not None:
                heapq.heappush(heap, (-scores[number], left, right, len(made)))
                if self.kinds[number] == UNUSED:
                    halves[made] = symbols[left], symbols[right]

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])

        def whole(symbol: str):
            if symbol in halves:
                for half in halves[symbol]:
                    yield from whole(half)
            else:
                yield symbol
        return [w for s in symbols if s for w in whole(s)]

    def encode(self, normal: str) -> tuple[list[int], list[int]]:
        """Ids of a normalised text and the number of normalised bytes each stands for."""
        ids, sizes = [], []
        find = self.ids.get
        for symbol in self.merge(normal):
            number = find(symbol)
            if number is not None:
                ids.append(number)
                sizes.append(len(symbol) if symbol.isascii() else len(symbol.encode()))
                continue
            raw = symbol.encode("utf-8", "replace")
            if self.byte_fallback:
                ids += [self.byte_ids[b] for b in raw]
                sizes += [1] * len(raw)
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return ids, sizes

    def decode_bytes(self, ids) -> bytes:
        """Surface of a run of ids, the dummy prefix included; stray bytes become the replacement character."""
        out, run = [], bytearray()

        def flush():
            i = 0
            while i < len(run):
                n = 1 + (run[i] >= 0xC0) + (run[i] >= 0xE0) + (run[i] >= 0xF0)
                try:
                    out.append(bytes(run[i:i + n]).decode().encode())
                    i += n
                except UnicodeDecodeError:
                    out.append("�".encode())
                    i += 1
            run.clear()

        for number in ids:
            kind = self.kinds[number]
            if kind == BYTE:
                run.append(int(self.pieces[number][3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(self.surface.encode())
            elif kind != CONTROL:
                out.append(self.pieces[number].replace(SPACE, " ").encode())
        flush()
        return b"".join(out)

    def decode(self, ids) -> str:
        """Text of the ids, without the space that encoding puts first."""
        text = self.decode_bytes(ids).decode()
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class BatchEncoder:
    """Encoding of many texts at once in numpy, for models whose words no merge crosses and that map no characters.

    The distinct words of a batch are arrays of symbol numbers; each round every word makes its best merge, the leftmost
    among equals, until no word has one.
    """

    LONG = 64  # symbols of a word that is merged by the heap instead

    def __init__(self, model: PieceModel):
        self.model = model
        count = len(model.pieces)
        single: dict[str, int] = {c: n for c, n in model.ids.items() if len(c) == 1}
        for c in sorted({c for p in model.ids for c in p}):
            single.setdefault(c, count + len(single))
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, n in single.items():
            self.symbol[ord(c)] = n
        number = dict(single) | model.ids
        left, right, made = [], [], []
        for piece, n in model.ids.items():
            for k in range(1, len(piece)):
                a, b = number.get(piece[:k]), number.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(n)
        self.score = np.array(model.scores, np.float64)
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = np.uint64(64 - (max(16, len(key)).bit_length() + 3))
        slot = (key * common.BASE) >> self.bits
        self.keys = np.full(1 << (64 - int(self.bits)), 2**64 - 1, np.uint64)
        self.made = np.full(len(self.keys), -1, np.int32)
        self.keys[slot] = key
        self.made[slot] = made
        lost = self.keys[slot] != key  # pairs whose slot another pair took
        order = np.argsort(key[lost])
        self.rest, self.rest_made = key[lost][order], np.array(made, np.int32)[lost][order]
        surfaces = [bytes([int(p[3:5], 16)]) if k == BYTE else model.surface.encode() if k == UNKNOWN else b"" if k == CONTROL
                    else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds)]
        self.surface_size = np.array(list(map(len, surfaces)), np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        decimal = [str(n).encode() + b"," for n in range(count)]
        self.digits_size = np.array(list(map(len, decimal)), np.int64)
        self.digits_start = np.cumsum(self.digits_size) - self.digits_size
        self.digits = np.frombuffer(b"".join(decimal), np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols merge to, -1 for nothing."""
        key = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        slot = (key * common.BASE) >> self.bits
        made = np.where(self.keys[slot] == key, self.made[slot], -1)
        if len(self.rest):
            open_ = np.flatnonzero(made < 0)
            place = np.minimum(np.searchsorted(self.rest, key[open_]), len(self.rest) - 1)
            made[open_] = np.where(self.rest[place] == key[open_], self.rest_made[place], -1)
        made[(left < 0) | (right < 0)] = -1
        return made

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of words after merging, characters of each symbol, and symbols of each word."""
        width, word = np.ones(len(symbols), np.int64), np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple] = []

        def offers(at):
            made = np.full(len(at), -1, np.int32)
            ok = at + 1 < len(symbols)
            ok[ok] &= word[at[ok]] == word[at[ok] + 1]
            made[ok] = self._pairs(symbols[at[ok]], symbols[at[ok] + 1])
            return made, np.where(made >= 0, self.score[made], -np.inf)

        made, score = offers(np.arange(len(symbols)))
        while len(symbols):
            first, count = common.runs(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.maximum.reduceat(score, first)
            live = np.repeat(best > -np.inf, count)
            if not live.all():
                done.append((word[~live], symbols[~live], width[~live]))
                symbols, width, word, made, score = symbols[live], width[live], word[live], made[live], score[live]
                if not len(symbols):
                    break
                best, count = best[best > -np.inf], count[best > -np.inf]
                first = np.cumsum(count) - count
            hit = np.flatnonzero(score == np.repeat(best, count))
            owner = word[hit]
            hit = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]
            symbols[hit] = made[hit]
            width[hit] += width[hit + 1]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, width, word, made, score = symbols[keep], width[keep], word[keep], made[keep], score[keep]
            at = hit - np.arange(len(hit))
            before = at[at > 0] - 1
            for spot in (at, before[word[before] == word[before + 1]]):
                made[spot], score[spot] = offers(spot)
        if not done:
            return symbols, width, np.zeros(len(sizes), np.int64)
        word, symbols, width = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], width[order], np.bincount(word, minlength=len(sizes))

    def encode(self, texts: list[str]):
        """Ids of all texts in a row, ids of each text, and the source bytes at which each id starts and ends."""
        model = self.model
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        full = np.flatnonzero(sizes)
        source = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        if model.dummy_prefix:
            code, source = np.insert(code, begin[full], 32), np.insert(source, begin[full], 0)
            begin[full] += np.arange(len(full))
            sizes[full] += 1
        code[code == 32] = ord(SPACE)
        if not len(code):
            none = np.zeros(0, np.int64)
            return none, np.zeros(len(texts), np.int64), none, none
        space = code == ord(SPACE)
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begin[full]] = True
        first, count = common.runs(start)
        sums, inverse = np.zeros(len(code) + 1, np.uint64), None
        power, inverse = common._long_powers(len(code) + 1)
        np.cumsum(common.mix(code.astype(np.uint64) + np.uint64(1)) * power[:len(code)], out=sums[1:])
        name = common.mix((sums[first + count] - sums[first]) * inverse[first] + count.astype(np.uint64))
        _, example, place = np.unique(name, return_index=True, return_inverse=True)
        w_first, w_count = first[example], count[example]
        long = w_count > self.LONG
        symbols, width, per_word = self._merge(self.symbol[code[common.within(w_first, np.where(long, 0, w_count))]],
                                               np.where(long, 0, w_count))
        if long.any():
            symbols, width, per_word = self._with_long(code, w_first, w_count, long, symbols, width, per_word)
        # Characters outside the vocabulary become their bytes, or one unknown piece for each run of them.
        ids, chars, into, parts = self._spell(code, w_first, symbols, width, per_word)
        start_of = np.cumsum(parts) - parts
        token = common.within(start_of[place], parts[place])
        per_unit = parts[place]
        base = np.repeat(first, per_unit)
        bounds = np.concatenate([[0], np.cumsum(source)])
        shift = np.repeat((np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "replace")) for t in texts])])[:-1]), sizes)
        low = base + into[token]
        text_of = np.searchsorted(begin[full], first, "right") - 1
        per_text = np.zeros(len(texts), np.int64)
        np.add.at(per_text, full[text_of], per_unit)
        return ids[token], per_text, bounds[low] - shift[low], bounds[low + chars[token]] - shift[low]

    def _with_long(self, code, w_first, w_count, long, symbols, width, per_word):
        """The merged symbols with those of the long words put in."""
        parts_s, parts_w, at = [], [], np.cumsum(per_word) - per_word
        number = self.model.ids
        for k in range(len(w_count)):
            if not long[k]:
                parts_s.append(symbols[at[k]:at[k] + per_word[k]])
                parts_w.append(width[at[k]:at[k] + per_word[k]])
                continue
            merged = self.model.merge("".join(map(chr, code[w_first[k]:w_first[k] + w_count[k]].tolist())))
            parts_s.append(np.array([number.get(m, self.symbol[ord(m[0])] if len(m) == 1 else -1) for m in merged], np.int32))
            parts_w.append(np.array([len(m) for m in merged], np.int64))
            per_word[k] = len(merged)
        return np.concatenate(parts_s), np.concatenate(parts_w), per_word

    def _spell(self, code, w_first, symbols, width, per_word):
        """Ids of words: number, characters covered, first character within the word, and ids of each word."""
        into = np.cumsum(width) - width
        begin = np.cumsum(per_word) - per_word
        word = np.repeat(np.arange(len(per_word)), per_word)
        into -= into[begin[word]] if len(into) else 0
        bad = (symbols < 0) | (symbols >= len(self.model.pieces))
        if not bad.any():
            return symbols.astype(np.int64), width, into, per_word
        value = code[w_first[word] + into]
        if self.model.byte_fallback:
            number = np.where(bad, 1 + (value >= 0x80).astype(np.int64) + (value >= 0x800) + (value >= 0x10000), 1)
            raw = np.frombuffer("".join(map(chr, value[bad].tolist())).encode("utf-8", "replace"), np.uint8)
            ids = np.repeat(symbols.astype(np.int64), number)
            ids[np.repeat(bad, number)] = np.array(self.model.byte_ids)[raw]
            return ids, np.repeat(width, number), np.repeat(into, number), np.bincount(np.repeat(word, number), minlength=len(per_word))
        ids = np.where(bad, self.model.unknown, symbols).astype(np.int64)
        new = np.ones(len(ids), bool)
        new[1:] = ~(bad[1:] & bad[:-1] & (word[1:] == word[:-1]))
        first = np.flatnonzero(new)
        return ids[first], np.add.reduceat(width, first), into[first], np.bincount(word[first], minlength=len(per_word))


_LOADED: dict[str, tuple[PieceModel, BatchEncoder | None]] = {}


def _load(path: str) -> tuple[PieceModel, BatchEncoder | None]:
    """Model, and the encoder of batches where the model allows one; once per worker."""
    if path not in _LOADED:
        model = PieceModel.load(path)
        _LOADED[path] = model, BatchEncoder(model) if model.splits and UNUSED not in model.kinds_used else None
    return _LOADED[path]


OUTPUTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "starts": T.ArrayType(T.LongType()),
           "ends": T.ArrayType(T.LongType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, model_path: str, text: str = "text",
           outputs: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends", "decoded")) -> DataFrame:
    """Every row with the chosen outputs: ``ids``; ``starts`` and ``ends`` of each piece's original bytes; the text
    ``decoded`` from the ids; the number of ids and digests of ids and decoded text.

    Whole texts are encoded, without begin or end ids. A null text counts as empty: no ids, empty decoded text. A piece
    that stands for no source byte (the space put first) has an empty span; pieces of one character share its span.
    New columns replace those of the same name, all others pass through; repeated rows get equal results.
    """
    fields = [T.StructField(o, OUTPUTS[o]) for o in outputs]

    def make():
        model, batch = _load(model_path)

        def run(texts: pa.Array):
            made: dict[str, list] = {o: [] for o in outputs}
            values = [t or "" for t in texts.to_pylist()]
            offsets = np.cumsum([0, *map(len, values)])
            for first, last in common.slices(offsets):
                _put(made, model, batch, values[first:last])
            return [pa.array(made[f.name], _ARROW[f.name]) for f in fields]
        return run

    return common.append(docs, [text], fields, make)


_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()),
          "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _put(made: dict[str, list], model: PieceModel, batch: BatchEncoder | None, texts: list[str]) -> None:
    """Append the outputs of some texts to ``made``."""
    if batch:
        ids, counts, starts, ends = batch.encode(texts)
    else:
        parts = []
        for text in texts:
            normal, low, high = model.normalise(text)
            found, sizes = model.encode(normal)
            stops = np.cumsum(np.array(sizes, np.int64))
            parts.append((found, low[stops - np.array(sizes, np.int64)], high[stops - 1]))
        ids = np.array([i for p in parts for i in p[0]], np.int64)
        counts = np.array([len(p[0]) for p in parts], np.int64)
        starts, ends = (np.concatenate([p[k] for p in parts]) if parts else ids for k in (1, 2))
    stops = np.cumsum(counts)
    bounds = list(zip((stops - counts).tolist(), stops.tolist()))
    for name, column in (("ids", ids), ("starts", starts), ("ends", ends)):
        if name in made:
            made[name] += [column[a:b] for a, b in bounds]
    if "n_tokens" in made:
        made["n_tokens"] += counts.tolist()
    if "ids_sha256" in made:
        sizes = np.array([len(str(n)) + 1 for n in range(len(model.pieces))], np.int64) if not batch else batch.digits_size
        if batch:
            shown = batch.digits[common.within(batch.digits_start[ids], sizes[ids])].tobytes()
        else:
            shown = b"".join(b"%d," % i for i in ids.tolist())
        at = np.concatenate([[0], np.cumsum(sizes[ids])])
        made["ids_sha256"] += [hashlib.sha256(shown[at[a]:max(at[b] - 1, at[a])]).hexdigest() for a, b in bounds]
    if "decoded" in made or "decoded_sha256" in made:
        if batch:
            surface = batch.surface[common.within(batch.surface_start[ids], batch.surface_size[ids])].tobytes()
            at = np.concatenate([[0], np.cumsum(batch.surface_size[ids])])
            raws = [surface[at[a]:at[b]] for a, b in bounds]
            if model.dummy_prefix:
                raws = [r[1:] if r.startswith(b" ") else r for r in raws]
        else:
            raws = [model.decode(ids[a:b].tolist()).encode() for a, b in bounds]
        if "decoded_sha256" in made:
            made["decoded_sha256"] += [hashlib.sha256(r).hexdigest() for r in raws]
        if "decoded" in made:
            made["decoded"] += [r.decode("utf-8", "replace") for r in raws]
