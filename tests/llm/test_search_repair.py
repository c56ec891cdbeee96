"""Conversation repair, presence-mask ranking and the permutation index against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import conversation_repair as repair, masked_ranking, permutation_index

TALK = "conv_id long, turn long, role string, text string, cost string"


def harmed(rows):
    out = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        out[conv] += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def brute(rows):
    """Every prefix's cheapest sequence for each role string so far, kept whole."""
    rows = sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def put(to, state, value):
        to[state] = min(to.get(state, value), value)

    def inserts(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for name in ("user", "assistant"):
                    if name[0] in follow[state]:
                        put(best, name[0], (cost + 3, audit + "I", lines + (name + ":",)))
        return best
    for (_, role, text), fault in zip(rows, faults):
        to = {}
        for state, (cost, audit, lines) in inserts(best).items():
            put(to, state, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                more = cost + (3 if fault else 0)
                if role[:1] and role[0] in follow[state]:
                    put(to, role[0], (more, audit + "K", lines + (f"{role}:{text}",)))
                for name in ("user", "assistant"):
                    if name[0] in follow[state]:
                        put(to, name[0], (more + 3, audit + "R", lines + (f"{name}:{text}",)))
        best = to
    best = inserts(best)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talks(seed):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(draw.choice([1, 2, 5, 9, 40])):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ux"])
            text = draw.choice(["Yes.", "No", " ", " \t", None, "Why? ", "ü!\n", "x" * draw.choice([3, 4000])])
            rows.append((conv, draw.choice([turn, turn, turn, None, 3]), role, text, "clash"))
    return rows


def test_repair_is_cheapest_and_least(spark):
    rows = talks(11)
    want = {c: brute(found) for c, found in harmed(rows).items()}
    got = {r[0]: tuple(r[1:]) for r in repair.report(repair.damage(spark.createDataFrame(rows, TALK).repartition(5))).collect()}
    assert got == want


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "S.", ""), (1, 1, "user", "Q?", ""), (1, 2, "user", "Q?", ""), (1, 4, "user", "A", ""), (2, None, "user", " ", "")]
    got = [tuple(r) for r in repair.repair(spark.createDataFrame(rows, TALK)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", 0, "system", "S.", None), (1, 1, "K", 1, "user", "Q?", None), (1, 2, "D", 2, "user", "Q?", "duplicate"),
                   (1, 3, "R", 4, "assistant", "A", "truncated"), (2, 0, "D", None, "user", " ", "blank")]
    assert repair.repair(spark.createDataFrame([], TALK)).count() == repair.report(repair.damage(spark.createDataFrame([], TALK))).count() == 0


def test_survivors_keep_little():
    """Once the survivors agree, decided edits leave; the tree does not grow with the conversation."""
    survivors, most, emitted = repair.Survivors(), 0, 0
    for k in range(20_000):
        emitted += len(survivors.row((k, "ua"[k % 2] if k % 97 else "x", "t.", None)))
        most = max(most, max(node.depth for _, node in survivors.best.values()) - survivors.root.depth)
    assert most < 20 and emitted > 19_000


DOCS = "doc_id long, text string, rank string, item_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t, *_ in docs]
    lengths = [sum(c.values()) for _, c in found]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for item, text, *_ in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, words in wanted.items():
        scores = []
        for (doc, count), n in zip(found, lengths):
            m = 50 + 50 * n * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * count[w] // (1000 * count[w] + 20 * m))
                    for w in words if count[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, place, doc, -s) for place, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(120)] + ["Ünder", "ünder", "É", "ab1", "AB1", "日本", "x y"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: draw.choice([" ", "-", "\n", "_"]).join(draw.choices(words, weights, k=n))
    docs = [(k, text(draw.choice([0, 1, 3, 20, 200])), "a", "b") for k in range(400)]
    docs += [(None, docs[7][1], "a", "b"), (None, None, "a", "b"), (7, docs[7][1], "a", "b"), (900, " .!", "a", "b"), (901, text(60_000), "a", "b")]
    docs += [(1000 + k, docs[11][1], "a", "b") for k in range(60)]  # ties
    items = [(k, text(draw.choice([1, 5, 12, 90])), "a") for k in range(30)] + [(50, None, "a"), (None, "w1 w2", "a"), (3, "w100 É", "a"), (51, "unknown", "a")]
    return docs, items


@pytest.mark.parametrize("limit", [10**6, 60])
def test_ranking_equals_brute_force(spark, limit):
    """In one pass and in several, over one shard and over many."""
    docs, items = corpus(12)
    left, right = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = masked_ranking.rank(left, right, k=20, terms=limit, shard=50 if limit == 60 else 4096)
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items, 20)


def test_ranking_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert masked_ranking.rank(docs, items).count() == 0
    assert masked_ranking.rank(spark.createDataFrame([(1, "a", "", "")], DOCS), items.filter("false")).count() == 0
    assert masked_ranking.rank(spark.createDataFrame([(1, None, "", "")], DOCS), items).count() == 0


def test_masks_stop_early():
    """Low masks are not evaluated, and the result is the exhaustive one."""
    draw = np.random.default_rng(1)
    hits = []
    for _ in range(5000):
        held = np.flatnonzero(draw.random(40) < 1 / (1 + np.arange(40)))
        hits.append(held.astype("<u4").tobytes() + draw.integers(1, 5, len(held)).astype("<u4").tobytes())
    index = masked_ranking.Shard(hits, draw.integers(50, 200, 5000))
    weights = np.arange(1, 41) * 100
    scored = []
    plain = index._scores
    index._scores = lambda rows, known: scored.append(len(rows)) or plain(rows, known)
    rows, scores = index.top(np.arange(40), weights, 10)
    every = plain(np.arange(5000), [(t, int(weights[t])) for t in range(40)])
    best = np.lexsort((np.arange(5000), -every))[:10]
    assert rows.tolist() == best.tolist() and scores.tolist() == every[best].tolist() and sum(scored) < 2500


VECTORS = "vec_id long, embedding array<double>, label int, rank string"


def test_permutation_index_finds_nearly_all(spark):
    """Recall of the default index against brute force, on directions that hardly cluster, and of unequal lengths."""
    draw = np.random.default_rng(13)
    n = 9000
    matrix = draw.standard_normal((n, 32)) * draw.choice([0.5, 1, 1.2], (n, 1))
    matrix[3000:6000] = matrix[5] + 0.3 * draw.standard_normal((3000, 32))
    rows = [(k, v.tolist(), 1, "x") for k, v in enumerate(matrix)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(6)
    got = defaultdict(list)
    for r in permutation_index.nearest(vectors, k=20, every=60, candidates=900).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, n, 60):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(s - scores[v]) <= 1e-9 for v, s in got[q])
        hits += len({v for v, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (20 * n / 60) >= 0.9


def test_odd_vectors(spark):
    """All candidates are reranked in small tables, so the result is exact there."""
    draw = np.random.default_rng(14)
    good = {k: draw.standard_normal(4).tolist() for k in range(60)}
    good[20], good[41] = [1e150, 0.0, -1e150, 1.0], good[40]
    bad = [None, [], [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [float("inf")] * 4, [None, 1.0, 1.0, 1.0]]
    rows = [(k, v, 0, "") for k, v in good.items()] + [(100 + k, v, 0, "") for k, v in enumerate(bad)]
    rows += [(140, [1.0, 2.0], 0, ""), (141, [3.0, 2.0], 0, ""), (None, [1.0] * 4, 0, ""), (40, good[40], 0, ""), (43, good[43], 0, "")]
    found = permutation_index.nearest(spark.createDataFrame(rows, VECTORS), k=7, every=20, shard=25, block=2)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 140} and got[140] == [(1, 141, 7.0)]
    for q in (0, 20, 40):
        scores = sorted((-float((np.array(v) * np.array(good[q])).sum()), k) for k, v, *_ in rows if k in good and k != q)[:7]
        assert [(k, -s) for s, k in scores] == [(k, s) for _, k, s in got[q]]
    assert permutation_index.nearest(spark.createDataFrame([], VECTORS)).count() == 0
