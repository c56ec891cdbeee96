"""Near-duplicate documents by a chosen-path similarity join over minwise tokens, confirmed on full shingle sets.

Documents with equal shingle sets form a class; only the class's least id goes on. Each of several independent trees
starts with all classes in one node. A node that is small is compared exhaustively by its minwise tokens. A large one
selects coordinates by its own hash, one or two so that 1/similarity are expected, and every document moves on to the
child named by its token there. What a small node finds alike, allowing for the error of the estimate, joins candidate
clusters; nodes that stay large to the last level become clusters whole. Inside clusters full sets are compared
exactly, in blocks where a cluster is large, and only links that join something new leave a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.components import components

TOKENS = 96  # minwise tokens of a document
TREES = 8
LEVELS = 6
NODE = 1000  # documents that one node compares exhaustively
BLOCK = 1024  # documents of one block of a large cluster
VISITORS = 8  # members of a large cluster that every block is compared with
MARGIN = 0.1  # allowed error of an estimated similarity; about 2.8 standard deviations at 0.85

_FACTORS = common.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * common.BASE) | np.uint64(1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle of all words, empty ones none."""
    hashes, _, _, first = common.words(offsets, data, lower=True)
    grams = common.rolling(hashes, width)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(grams[a:b - width + 1])
        elif b > a:
            yield common.rolling(hashes[a:b], int(b - a)) + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def tokens(items: np.ndarray) -> bytes:
    """Minwise tokens of a set: for each coordinate the least of its items under that coordinate's multiplier."""
    best = np.full(TOKENS, 2**64 - 1, np.uint64)
    for k in range(0, len(items), 2048):
        part = items[k:k + 2048]
        np.minimum(best, (_FACTORS[:, None] * part[None, :]).min(1), out=best)
    return (best >> np.uint64(32)).astype("<u4").tobytes()


def signatures(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, sum_a, sum_b, tokens``: size, two hashes and minwise tokens of each set."""
    def task(batches):
        for batch in batches:
            offsets, data = common.utf8(batch.column(1))
            sizes, a, b, made = [], [], [], []
            for first, last in common.slices(offsets):
                local = offsets[first:last + 1] - offsets[first]
                for items in shingle_sets(local, data[offsets[first]:offsets[last]], width):
                    sizes.append(len(items))
                    a.append(int(items.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(common.mix(items + common.BASE).sum(dtype=np.uint64).view(np.int64)))
                    made.append(tokens(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                              pa.array(made, pa.binary())], names=["doc_id", "n_shingles", "sum_a", "sum_b", "tokens"])
        common.give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
        task, "doc_id long, n_shingles long, sum_a long, sum_b long, tokens binary")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, TOKENS)


def branch(nodes: np.ndarray, sketches: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and child node of each step down: a node's hash selects one coordinate, and a second one as often as brings
    the expected number to 1 / similarity."""
    h = common.mix(nodes ^ common.BASE)
    rows = np.arange(len(nodes))
    one = (h % np.uint64(TOKENS)).astype(np.int64)
    two = ((common.mix(h) >> np.uint64(8)) % np.uint64(TOKENS)).astype(np.int64)
    extra = (h >> np.uint64(40)).astype(np.float64) / 2**24 < 1 / similarity - 1
    extra &= one != two
    row = np.concatenate([rows, rows[extra]])
    coordinate = np.concatenate([one, two[extra]])
    value = sketches[row, coordinate].astype(np.uint64)
    return row, common.mix(nodes[row] * common.BASE + (coordinate.astype(np.uint64) << np.uint64(32)) + value)


def _step(frontier: DataFrame, similarity: float) -> DataFrame:
    """Children ``id, node`` of rows ``id, node, tokens``."""
    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            row, child = branch(nodes, _matrix(batch.column(2)), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(child.view(np.int64))], names=["id", "node"])
    return frontier.select("id", "node", "tokens").mapInArrow(task, "id long, node long")


def _alike(ids: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Within nodes (rows sorted by node): pairs alike by their tokens, at most one for each document and later one it
    is not yet joined to."""
    parent = np.arange(len(ids))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []

    def join(a, b):
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(ids[x])
                right.append(ids[y])

    bounds = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1], [True]]))
    sizes = np.diff(bounds)
    small = np.repeat(sizes <= 32, sizes)
    last = np.repeat(bounds[1:], sizes)
    for step in range(1, 32):
        rows = np.flatnonzero(small & (np.arange(len(ids)) + step < last))
        if not len(rows):
            break
        for part in np.array_split(rows, len(rows) // 20000 + 1):
            same = (sketches[part] == sketches[part + step]).sum(1)
            hit = part[same >= least]
            join(hit, hit + step)
    for start, stop in zip(bounds[:-1][sizes > 32], bounds[1:][sizes > 32]):
        columns = np.ascontiguousarray(sketches[start:stop].T)
        for k in range(0, stop - start, 256):
            same = np.zeros((min(256, stop - start - k), stop - start), np.uint8)
            for column in columns:
                same += column[k:k + 256, None] == column[None, :]
            a, b = np.nonzero(same >= least)
            keep = b > a + k
            join(start + k + a[keep], start + b[keep])
    return np.array(left, np.int64), np.array(right, np.int64)


def candidate_links(classes: DataFrame, similarity: float) -> DataFrame | None:
    """Links ``a, b`` whose components are the candidate clusters of ``classes (id, tokens)``."""
    least = int(np.ceil((similarity - MARGIN) * TOKENS))
    count = classes.count()
    spark = classes.sparkSession
    if count < 2:
        return None
    levels, links = [], []
    if count <= NODE:
        levels.append(classes.select("id", F.lit(0).cast("long").alias("node")))
    else:
        roots = F.explode(F.array([F.lit(int(common.mix(np.array([t + 1], np.uint64)).view(np.int64)[0])) for t in range(TREES)]))
        frontier = classes.withColumn("node", roots)
        for level in range(LEVELS):
            paths = common.scratch(_step(frontier, similarity), "paths")
            sizes = paths.groupBy("node").count().filter("count > 1")
            paths = common.scratch(paths.join(sizes.hint("merge"), "node").select("id", "node", "count"), "paths")
            levels.append(paths.filter(F.col("count") <= NODE).select("id", "node"))
            large = paths.filter(F.col("count") > NODE).select("id", "node")
            if large.isEmpty():
                break
            if level == LEVELS - 1:
                first = large.groupBy("node").agg(F.min("id").alias("b"))
                links.append(large.join(first, "node").select(F.col("id").alias("a"), "b"))
            else:
                frontier = large.join(classes, "id")
    small = levels[0]
    for more in levels[1:]:
        small = small.unionByName(more)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), count * TREES // 100_000)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("id", "ascending")])
        a, b = _alike(table["id"].to_numpy(), table["node"].to_numpy(), _matrix(table["tokens"]), least)
        common.give_back()
        return pa.table({"a": a, "b": b})

    compared = (small.join(classes.hint("merge"), "id").withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
                .groupBy("bucket").applyInArrow(compare, "a long, b long"))
    for more in links:
        compared = compared.unionByName(more)
    return compared


def _confirmed(ids: Sequence[int], sets: list[np.ndarray], percent: int, joined: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """Links of one block: pairs with 100 * intersection >= percent * union that join something new.

    Rows of equal ``joined`` are known to be connected.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    labels = np.arange(n) if joined is None else np.unique(joined, return_inverse=True)[1]
    if n <= 24:
        shared = np.zeros((n, n))
        for x in range(n):
            for y in range(x + 1, n):
                if labels[x] != labels[y] and 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y]):
                    shared[x, y] = shared[y, x] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    else:
        shared = _intersections(sets, sizes)
    hit = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    links, unseen = [], np.ones(n, bool)
    by_label = np.argsort(labels, kind="stable")
    first = np.searchsorted(labels[by_label], np.arange(labels.max() + 2)) if n else []
    for start in range(n):
        stack = [start] if unseen[start] else []
        while stack:
            x = stack.pop()
            if unseen[x]:  # all that are joined to it already come along
                together = by_label[first[labels[x]]:first[labels[x] + 1]]
                unseen[together] = False
                stack += together.tolist()
                continue
            for y in np.flatnonzero(hit[x] & unseen).tolist():
                if unseen[y]:
                    links.append((ids[x], ids[y]))
                    together = by_label[first[labels[y]]:first[labels[y] + 1]]
                    unseen[together] = False
                    stack += together.tolist()
    return links


def _intersections(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Numbers of shared items of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.full(len(count), -1)
    shared = np.flatnonzero(count > 1)
    place[shared] = np.arange(len(shared))
    number = place[number]
    owner, number = owner[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    both = np.zeros((n, n), np.float32)
    for start in range(0, len(shared), 2048):
        low, high = np.searchsorted(number, [start, start + 2048])
        matrix = np.zeros((n, min(2048, len(shared) - start)), np.float32)
        matrix[owner[low:high], number[low:high] - start] = 1
        both += matrix @ matrix.T
    return both.astype(np.float64)


def _with_sets(docs: DataFrame, members: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """``members (id, ...)`` with ``items``, the sorted shingle hashes of the document."""
    keep = [c for c in members.columns if c != "id"]
    schema = members.select("id", *keep).schema.add("items", "binary")

    def build(batches):
        for batch in batches:
            offsets, data = common.utf8(batch.column(batch.num_columns - 1))
            made = []
            for first, last in common.slices(offsets):
                local = offsets[first:last + 1] - offsets[first]
                made += [s.tobytes() for s in shingle_sets(local, data[offsets[first]:offsets[last]], width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=schema.names)
        common.give_back()

    texts = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    return (texts.join(members.hint("merge"), F.col("_doc") == F.col("id")).select("id", *keep, "_text").mapInArrow(build, schema))


def _roots(ids: Sequence[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """Least id that each id reaches over the links."""
    parent = dict.fromkeys(ids)
    for x in parent:
        parent[x] = x

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for x, y in links:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def _links_in_units(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b, label, cluster``: links between rows ``unit, cluster, id, joined, visitor, items`` of one unit and cluster, label false.

    Where a cluster has visitors, every row ``a`` also gets a label ``b``, equal for rows that are certainly connected in all
    units: that of a visitor it reaches, else the least id it reaches.
    """
    def confirm(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("id", "ascending")])
        ids, owners, joined = (table[c].to_numpy() for c in ("id", "cluster", "joined"))
        visitors = table["visitor"].to_numpy()
        items = table["items"]
        links: list[tuple[int, int]] = []
        labels: dict[int, tuple[int, int]] = {}
        bounds = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]])) if len(ids) else [0]
        for start, stop in zip(bounds[:-1], bounds[1:]):
            _, rows_kept = np.unique(ids[start:stop], return_index=True)
            sets = [np.frombuffer(items[int(start + k)].as_py(), np.uint64) for k in rows_kept]
            here = ids[start:stop][rows_kept].tolist()
            found = _confirmed(here, sets, percent, joined[start:stop][rows_kept])
            links += found
            known = np.flatnonzero(visitors[start:stop][rows_kept])
            if len(known):
                named = [here[k] for k in known]
                label = _roots(named, _confirmed(named, [sets[k] for k in known], percent))
                reached, best = _roots(here, found), {}
                for x in named:
                    best[reached[x]] = min(best.get(reached[x], label[x]), label[x])
                for x in here:
                    labels[x] = label[x] if x in label else best.get(reached[x], reached[x]), int(owners[start])
        common.give_back()
        pairs = links + [(x, y) for x, (y, _) in labels.items()]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64()),
                         "label": pa.array([False] * len(links) + [True] * len(labels), pa.bool_()),
                         "cluster": pa.array([None] * len(links) + [c for _, c in labels.values()], pa.int64())})

    return rows.select("unit", "cluster", "id", "joined", "visitor", "items").groupBy("unit").applyInArrow(confirm, "a long, b long, label boolean, cluster long")


def confirmed_links(docs: DataFrame, clusters: DataFrame, width: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """Links ``a, b`` of the documents ``clusters (id, cluster)`` that hold on their full sets.

    A cluster beyond one block is settled in two steps. First each block is compared in itself and with a few members of the
    cluster that visit all blocks, which joins nearly all of a group of near copies; every other set is shipped once. What is
    joined then need not be compared again: only members outside the largest joined part meet the other blocks.
    """
    visitors = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(VISITORS)]))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), visitors.alias("visitors"))
    blocks = F.ceil(F.col("n") / BLOCK)
    members = common.scratch(clusters.join(sizes, "cluster").select(
        "id", "cluster", F.col("id").alias("joined"), (F.array_contains("visitors", F.col("id")) & (F.col("n") > BLOCK)).alias("visitor"), "n",
        F.pmod(F.xxhash64("id"), blocks).alias("block")), "members")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = _with_sets(docs, members, width, text, doc_id)
    together = F.pmod(F.xxhash64("cluster"), F.lit(buckets))
    if members.filter(F.col("n") > BLOCK).isEmpty():
        return _links_in_units(sets.withColumn("unit", together), percent).select("a", "b")
    sets = common.scratch(sets, "sets")
    visits = F.when(F.col("visitor"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array("block"))
    unit = F.when(F.col("n") > BLOCK, F.xxhash64("cluster", "visit")).otherwise(together)
    near = common.scratch(_links_in_units(sets.withColumn("visit", F.explode(visits)).withColumn("unit", unit), percent), "near")
    links = near.filter("NOT label").select("a", "b")
    parts = near.filter("label").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("part"), F.min("cluster").alias("cluster"))
    core = parts.groupBy("cluster", "part").count().groupBy("cluster").agg(
        F.max(F.struct("count", "part"))["part"].alias("core"), (F.sum("count") - F.max("count")).alias("left")).filter(F.col("left") > 0)
    open_ = common.scratch(parts.join(core, "cluster").select("id", F.col("part").alias("joined"), "core", "left"), "open")
    if open_.isEmpty():
        return links
    chunks = F.ceil(F.col("left") / BLOCK)
    known = sets.drop("joined", "visitor").join(open_.hint("merge"), "id").withColumn("visitor", F.lit(False))
    here = known.withColumn("visit", F.col("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    there = known.filter(F.col("joined") != F.col("core")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), chunks)) \
        .withColumn("visit", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    columns = ["cluster", "id", "joined", "visitor", "items", "visit", "chunk"]
    met = here.select(*columns).unionByName(there.select(*columns))
    return links.unionByName(_links_in_units(met.withColumn("unit", F.xxhash64("cluster", "visit", "chunk")), percent).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a set holds the distinct shingles of
    ``width`` words. Documents link when 100 * intersection >= ``percent`` * union; ``component_id`` is the least id
    reached, and the document that bears it is ``kept``. A null, empty or blank text has an empty set and links with
    nothing; a shorter text is one shingle. Rows that repeat an id get equal results. A row with a null id stays
    alone: component null, kept. Whole texts count; other columns take no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    all_signed = common.scratch(signatures(docs, width, text, doc_id), "signed")
    key = ["n_shingles", "sum_a", "sum_b"]
    signed = all_signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = common.scratch(signed.groupBy(*key).agg(F.min("doc_id").alias("id")), "classes")
    heads = common.scratch(signed.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi")
                           .select(F.col("doc_id").alias("id"), "tokens").dropDuplicates(["id"]), "heads")
    similarity = percent / 100
    candidates = candidate_links(heads, similarity)
    if candidates is None:
        reached = spark.createDataFrame([], "vertex long, component_id long")
    else:
        clusters = components(candidates, "a", "b").select(F.col("vertex").alias("id"), F.col("component_id").alias("cluster"))
        reached = components(confirmed_links(docs, clusters, width, percent, text, doc_id), "a", "b")
    found = classes.join(reached, F.col("id") == F.col("vertex"), "left").select(*key, F.coalesce("component_id", "id").alias("component_id"))
    full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    linked = all_signed.filter(full).drop("tokens").join(found.hint("merge"), key)
    alone = all_signed.filter(~full).drop("tokens").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
