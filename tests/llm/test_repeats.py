"""Removal of repeated word windows and byte strings against brute force."""

import hashlib
import random
import re

import pytest

from tidemark.llm import repeat_groups, substring_dedup

COLUMNS = "doc_id long, text string, n_words string, n_bytes string, doc int, start int, bucket string"


def brute_words(rows, window):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in rows}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s:s + window]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (d, s):
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept
    return out


def brute_bytes(rows, window):
    raw = {d: (t or "").encode() for d, t in rows}
    places = {}
    for d, b in raw.items():
        for s in range(len(b) - window + 1):
            places.setdefault(b[s:s + window], []).append((d, s))
    gone = {d: bytearray(len(b)) for d, b in raw.items()}
    for found in places.values():
        if len(found) > 1:
            for d, s in found:
                gone[d][s:s + window] = b"\1" * window
    out = {}
    for d, b in raw.items():
        kept = bytes(x for x, g in zip(b, gone[d]) if not g)
        out[d] = len(b), sum(gone[d]), len(re.findall(b"\1+", bytes(gone[d]))), hashlib.sha256(kept).hexdigest(), kept
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    vocabulary = ["a", "b", "the", "of", "é", "漢", *[f"w{k}" for k in range(30)]]
    passages = [" ".join(draw.choices(vocabulary, k=draw.randrange(10, 60))) for _ in range(12)]
    out = [(k, t) for k, t in enumerate(["", None, "   \n", "a", "a " * 400, "ab" * 900, "x\ty\nz " * 80, passages[0], passages[0], "\x00\x00" * 90, "é" * 300])]
    for k in range(20, 140):
        parts = []
        for _ in range(draw.randrange(1, 8)):
            parts.append(draw.choice(passages[:3]) if draw.random() < 0.3 else draw.choice(passages) if draw.random() < 0.2
                         else " ".join(draw.choices(vocabulary, k=draw.randrange(1, 40))))
        out.append((k, draw.choice([" ", "\n", "  "]).join(parts)))
    draw.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    data = [(d, t, "s", "s", 1, 2, "b") for d, t in rows]
    twice = next(r for r in data if r[0] == 40)
    return spark.createDataFrame(data + [twice, (None, "null id", "s", "s", 1, 2, "b")], COLUMNS).repartition(6)


@pytest.mark.parametrize("window,gram,slice_bytes", [(20, 8, 1 << 21), (9, 3, 3000)])
def test_words(spark, rows, frame, monkeypatch, window, gram, slice_bytes):
    monkeypatch.setattr(substring_dedup, "GRAM", gram)
    monkeypatch.setattr(substring_dedup.common.slices, "__defaults__", (slice_bytes,))
    want = brute_words(rows, window)
    assert sum(w[1] for w in want.values()) > 500
    got = substring_dedup.remove_repeats(frame, window).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is not None:
            n, removed, digest, kept = want[r["doc_id"]]
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, digest), r["doc_id"]
            text = dict(rows)[r["doc_id"]]
            if not removed:
                assert r["kept_text"] == text
            else:
                assert b" ".join(r["kept_text"].encode().split()) == kept
    assert set(got[0].asDict()) == {"doc_id", "text", "n_bytes", "doc", "start", "bucket", "n_words", "n_removed", "kept_sha256", "kept_text"}
    assert substring_dedup.remove_repeats(frame.limit(0), window).count() == 0


@pytest.mark.parametrize("window,scan,slice_bytes", [(60, 256, 1 << 21), (25, 3, 2000), (40, 256, 500)])
def test_bytes(spark, rows, frame, monkeypatch, window, scan, slice_bytes):
    monkeypatch.setattr(repeat_groups, "SCAN", scan)
    monkeypatch.setattr(repeat_groups.common.slices, "__defaults__", (slice_bytes,))
    want = brute_bytes(rows, window)
    assert sum(w[1] for w in want.values()) > 2000
    got = repeat_groups.remove_repeats(frame, window).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
    assert repeat_groups.remove_repeats(frame.limit(0), window).count() == 0


def _without_ids():
    """Rows that share an id or have none: (id, text, number of the document that it is)."""
    draw = random.Random(3)
    own = [" ".join(draw.choices([f"v{k}" for k in range(400)], k=40)) for _ in range(12)]
    shared, other, third = (" ".join(draw.choices([f"u{k}" for k in range(400)], k=30)) for _ in range(3))
    # The shared passage starts at the same place in two rows without id; two more are equal; an id has two texts.
    rows = [(None, f"{shared} {own[0]}"), (None, f"{shared} {own[1]}"), (None, own[2]), (None, own[2]), (None, f"{own[3]} {other}"),
            (None, f"{own[4]} {own[5]}"), (7, f"{other} {own[6]}"), (7, f"{own[7]} {own[8]}"), (8, f"{own[9]} {third}"), (None, f"{third} {own[10]}")]
    number = {}
    return [(i, t, number.setdefault((i, t), len(number))) for i, t in rows]


def test_bytes_of_rows_without_ids(spark):
    rows = _without_ids()
    want = brute_bytes([(d, t) for d, t in {n: t for _, t, n in rows}.items()], 60)
    assert sum(w[1] > 0 for w in want.values()) == 6
    got = repeat_groups.remove_repeats(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3), 60).collect()
    texts = sorted((r["text"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert texts == sorted((t, *want[n][1:4]) for _, t, n in rows)


def test_words_of_rows_without_ids(spark):
    rows = [r for r in _without_ids() if r[0] != 7]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    got = {r["text"]: r["n_removed"] for r in substring_dedup.remove_repeats(frame, 20).collect()}
    # One of the two copies in rows without id goes, equal rows stay, and what an id has comes first.
    assert sorted([got[rows[0][1]], got[rows[1][1]]]) == [0, 30] and got[rows[-1][1]] == 30
    assert sum(got.values()) == 60


def test_interval_tree_and_maximal_repeats():
    strings = sorted([b"banana", b"bandana", b"bandit", b"cab", b"cabin", b"x"])
    prefixes = [len(__import__("os").path.commonprefix([a, b])) for a, b in zip(strings, strings[1:])]
    found = sorted(repeat_groups.interval_tree(repeat_groups.np.array(prefixes)))
    assert found == [(0, 0, 5), (3, 0, 2), (3, 3, 4), (4, 1, 2)]
    groups = [(before.tolist(), after, sorted(rows.tolist())) for before, after, rows in
              repeat_groups.maximal_repeats([b"qab", b"zab", b"b", b""], [b"cdef", b"cdeg", b"cdef", b"q"], 5)]
    assert ([2, 2], 3, [0, 1]) in groups and ([1, 1], 4, [0, 2]) in groups or any(g[2] == [0, 2] and g[1] == 4 for g in groups)
