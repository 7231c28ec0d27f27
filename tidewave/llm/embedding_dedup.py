"""Operator 9: near-duplicate embeddings by NN-descent.

1. Equal vectors are one node. A first neighbour graph comes from random
   hyperplane codes: nodes of equal code are compared in blocks.
2. NN-descent rounds: each node compares its neighbours and those it is a
   neighbour of with each other, and lists keep the nearest. Only pairs with a
   new edge are compared. A list whose last entry still reaches the threshold
   is saturated and doubles, up to ``MOST_NEIGHBOURS``.
3. Rounds go on until few nodes gain a link. Then come fresh codes: how many
   nodes they give a link that was not known tells what is still lost, also
   among pairs too rare for a sample. A bounded sample of nodes, drawn by how
   many links they are known to have, is compared with all rows besides. While
   either falls short of ``WANTED_RECALL`` more codes and rounds follow; a
   recall that stays below ``LEAST_RECALL`` makes all blocks meet each other.
   The figures are logged.
4. Edges that reach the threshold in double precision give the components.
   A list of a dense group may hold none of the links to another dense group:
   components with a node of ``NEIGHBOURS`` links are cut into cells around
   pivots, cells of two components that angles don't rule out are compared in
   full, and components that link are joined. Links are then counted exactly
   inside each component, in blocks; no pair is ever written.

Large code blocks, hubs and components are split by hash, so no task gathers an
unbounded group. Vectors of different lengths don't link: each length is
searched by itself, one other than the most frequent of up to ``FULL_NODES``
distinct vectors by comparing all. Vectors that are null, empty, zero, or hold
null or non-finite components link with nothing. Repeated ids are rows of their
own; rows of equal vectors link with each other. An empty table gives none;
columns beyond vec_id and embedding aren't read and may have any name.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import components, materialize

THRESHOLD = 0.95
#: Float similarities this close below the threshold are still verified.
SLACK = 1e-4
NEIGHBOURS, MOST_NEIGHBOURS = 10, 40
CODES, CODE_NODES, BLOCK_NODES = 3, 96, 256
GROUP_NODES, TASK_NODES = 64, 8000
ROUNDS, ROUNDS_LATER, MOST_ROUNDS, PASSES = 3, 1, 8, 6
#: Rounds end when a smaller share of the linked nodes gains a link.
CHANGED = 0.01
#: Cells of a dense component at most; cells and nodes of a block; nodes of a cell that are tried before all.
MOST_CELLS, BLOCK_CELLS, TRIED_NODES = 512, 2048, 64
#: Nodes of each kind (no, few, many known links) that the audit compares with all rows; a documented bound.
AUDITED, WANTED_RECALL, LEAST_RECALL = 256, 0.97, 0.9

#: Distinct vectors of a less frequent length that one task compares with each other.
FULL_NODES = 2048

_LOG = logging.getLogger(__name__)
_LISTS = "id long, ids binary, sims binary"


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column]).astype(kind) if len(column) else np.zeros((0, 1), kind)


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each distinct key."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else []


def _nearest(ids: np.ndarray, sims: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each node the ``k`` nearest of a block that exceed its least similarity."""
    for i, own in enumerate(sims):
        own[i] = -2
        at = np.flatnonzero(own > least[i])
        if len(at) > k:
            at = at[np.argpartition(-own[at], k - 1)[:k]]
        if len(at):
            yield int(ids[i]), ids[at].tobytes(), own[at].astype(np.float32).tobytes()


def _rows(found: list[tuple[int, bytes, bytes]]) -> pa.Table:
    a, b, c = zip(*found) if found else ((), (), ())
    return pa.table({"id": pa.array(a, pa.int64()), "ids": pa.array(b, pa.binary()), "sims": pa.array(c, pa.binary())})


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: vec_id, node; nodes: id, least_id, n, d, x): the rows of each node; its length and its unit vector as bytes."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    good = materialize(rows.where(F.coalesce(sound, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")
    good = good.withColumn("key", F.xxhash64("v"))
    classes = good.groupBy("key", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.list_value_length(whole["v"]).to_numpy()
            for d in np.unique(lengths):
                batch = whole.filter(pa.array(lengths == d))
                x = batch["v"].flatten().to_numpy().reshape(len(batch), -1)
                x = x / np.abs(x).max(1, initial=1e-300)[:, None]  # so that squares stay finite, and above zero
                x = x / np.sqrt((x * x).sum(1))[:, None]
                yield pa.record_batch([batch["key"], batch["id"], batch["n"], pa.array(np.full(len(x), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "id", "n", "d", "x"])

    known = materialize(classes.mapInArrow(unit, "key long, id long, n long, d int, x binary"), "nodes")
    # an id may repeat with another vector: nodes get numbers of their own
    known = known.withColumn("node", F.xxhash64("key", "id"))
    known = materialize(known.select("key", "node", F.col("id").alias("least_id"), "n", "d", "x"), "numbered")
    members = good.select("vec_id", "key").join(known.select("key", "node"), "key").select("vec_id", "node")
    return members, known.select(F.col("node").alias("id"), "least_id", "n", "d", "x")


def _codes(bits: int) -> int:
    """Codes of a pass, so that two passes bring a pair at the threshold together with probability ``WANTED_RECALL``."""
    alike = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return CODES if alike == 1 else max(CODES, int(np.ceil(np.log(1 - WANTED_RECALL) / np.log(1 - alike) / 2)))


def _by_codes(x: DataFrame, n: int, seed: int) -> DataFrame:
    """Lists of near nodes among those of equal random-hyperplane code."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / CODE_NODES))))
    number = _codes(bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch["x"], np.float32)
            for t in range(number):
                planes = np.random.default_rng([seed, t]).standard_normal((m.shape[1], bits)).astype(np.float32)
                codes = ((m @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) if bits else np.zeros(len(m), np.int64)
                yield pa.record_batch([pa.array(codes * number + t), batch["id"]], ["code", "id"])

    codes = materialize(x.mapInArrow(code, "code long, id long"), "codes")
    sizes = codes.groupBy("code").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("parts"))
    placed = codes.join(sizes, "code").select("id", F.xxhash64("code", F.pmod(F.xxhash64("id", F.lit(seed)), "parts")).alias("group"))
    tasks = max(4, number * n // TASK_NODES)

    def compare(t: pa.Table) -> pa.Table:
        group, ids, m, found = _ids(t["group"]), _ids(t["id"]), _matrix(t["x"], np.float32), []
        for rows in _groups(group):
            found += _nearest(ids[rows], m[rows] @ m[rows].T, np.full(len(rows), -2.0), NEIGHBOURS)
        return _rows(found)

    return placed.join(x.select("id", "x"), "id").withColumn("task", F.pmod("group", F.lit(tasks))).groupBy("task").applyInArrow(compare, _LISTS)


def _merge(found: DataFrame, graph: DataFrame | None) -> DataFrame:
    """The graph (id, k, ids, sims, news) with what was found; saturated lists double."""
    rows = found.select("id", F.lit(NEIGHBOURS).alias("k"), "ids", "sims", F.lit(None).cast("binary").alias("news"))
    # two steps, so that what many groups found for a hub is not gathered at once

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, k, ids, sims, news in zip(batch["id"].to_pylist(), batch["k"].to_pylist(), batch["ids"].to_pylist(), batch["sims"].to_pylist(), batch["news"].to_pylist()):
                u, s = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float32)
                new = np.concatenate([np.frombuffer(f, np.uint8) if f is not None else np.ones(len(i) // 8, np.uint8) for i, f in zip(ids, news)])
                order = np.lexsort((new, -s, u))
                u, s, new = u[order], s[order], new[order]
                head = np.concatenate([[True], u[1:] != u[:-1]]) & (u != node)
                # an edge that was known is not new
                u, s, new = u[head], s[head], np.minimum.reduceat(new, np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])))[(u[np.concatenate([[True], u[1:] != u[:-1]])] != node)]
                order = np.lexsort((u, -s))[:k]
                out.append((node, k, u[order].tobytes(), s[order].tobytes(), new[order].tobytes()))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["id", "k", "ids", "sims", "news"])

    shape = "id long, k int, ids binary, sims binary, news binary"
    gather = [F.max("k").alias("k"), *[F.collect_list(c).alias(c) for c in ("ids", "sims")], F.collect_list(F.coalesce("news", F.expr("cast(repeat(char(1), cast(length(ids) / 8 as int)) as binary)"))).alias("news")]
    if graph is not None:
        rows = rows.unionByName(graph)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(16)))
    first = rows.groupBy("id", "salt").agg(*gather).drop("salt").select("id", "k", "ids", "sims", "news")
    if graph is not None:  # a salted part must not be cut below the list's own length
        first = first.withColumn("k", F.greatest("k", F.lit(MOST_NEIGHBOURS)))
    wide = first.mapInArrow(best, shape)
    own = graph.select("id", F.col("k").alias("own_k")) if graph is not None else None
    merged = wide.groupBy("id").agg(*gather[1:])
    merged = merged.join(own, "id", "left").withColumn("k", F.coalesce("own_k", F.lit(NEIGHBOURS))) if own is not None else merged.withColumn("k", F.lit(NEIGHBOURS))
    return merged.select("id", "k", "ids", "sims", "news").mapInArrow(best, shape)


def _edges(graph: DataFrame) -> DataFrame:
    """(id, k, worst, other, sim, new) of each list entry; worst: -2 while the list has room."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.float32), np.frombuffer(c, np.uint8)) for a, b, c in zip(batch["ids"].to_pylist(), batch["sims"].to_pylist(), batch["news"].to_pylist())]
            sizes, k = np.array([len(a) for a, _, _ in lists], np.int64), batch["k"].to_numpy()
            worst = np.array([b[-1] if len(b) >= m else -2.0 for (_, b, _), m in zip(lists, k)], np.float32)
            joined = [np.concatenate([x[j] for x in lists]) if lists else np.zeros(0, np.int64) for j in range(3)]
            yield pa.record_batch([pa.array(np.repeat(_ids(batch["id"]), sizes)), pa.array(np.repeat(k, sizes), pa.int32()), pa.array(np.repeat(worst, sizes), pa.float32()), pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.float32()), pa.array(joined[2].astype(bool))], ["id", "k", "worst", "other", "sim", "new"])

    return graph.mapInArrow(spread, "id long, k int, worst float, other long, sim float, new boolean")


def _round(x: DataFrame, graph: DataFrame, n: int, seed: int) -> DataFrame:
    """One round of NN-descent: the graph after comparing neighbours of each node with each other."""
    edges = _edges(graph)
    sides = edges.select(F.col("id").alias("centre"), F.col("other").alias("id"), "new").union(edges.select(F.col("other"), "id", "new"))
    sides = materialize(sides.groupBy("centre", "id").agg(F.max("new").alias("new")), "sides")
    sizes = sides.groupBy("centre").agg(F.count("*").alias("degree"), F.max("new").alias("any")).where("any")
    placed = sides.join(sizes, "centre")
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("degree") / GROUP_NODES))
    placed = placed.select("id", "new", F.xxhash64("centre", part).alias("group"))
    least = edges.groupBy("id").agg(F.max("worst").alias("worst"), F.max("k").alias("k"))
    known = x.select("id", "x").join(least, "id", "left")
    tasks = max(4, 2 * NEIGHBOURS * n // TASK_NODES)

    def compare(t: pa.Table) -> pa.Table:
        group, ids, new = _ids(t["group"]), _ids(t["id"]), t["new"].to_numpy()
        m, worst = _matrix(t["x"], np.float32), t["worst"].fill_null(-2.0).to_numpy()
        found = []
        for rows in _groups(group):
            if new[rows].any() and len(rows) > 1:
                sims = m[rows] @ m[rows].T
                sims[~(new[rows][:, None] | new[rows][None, :])] = -2
                found += _nearest(ids[rows], sims, worst[rows], NEIGHBOURS)
        return _rows(found)

    found = placed.join(known, "id").withColumn("task", F.pmod("group", F.lit(tasks))).groupBy("task").applyInArrow(compare, _LISTS)

    def age(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What was compared is old; a saturated list doubles and counts as new."""
        for batch in batches:
            k, news = batch["k"].to_numpy().copy(), []
            for i, sims in enumerate(batch["sims"].to_pylist()):
                s = np.frombuffer(sims, np.float32)
                full = len(s) >= k[i] and s[-1] >= THRESHOLD - SLACK and k[i] < MOST_NEIGHBOURS
                k[i] = min(MOST_NEIGHBOURS, 2 * k[i]) if full else k[i]
                news.append((np.ones if full else np.zeros)(len(s), np.uint8).tobytes())
            yield pa.record_batch([batch["id"], pa.array(k, pa.int32()), batch["ids"], batch["sims"], pa.array(news, pa.binary())], ["id", "k", "ids", "sims", "news"])

    old = graph.mapInArrow(age, "id long, k int, ids binary, sims binary, news binary")
    return materialize(_merge(found, old), "graph")


def _links(x: DataFrame, graph: DataFrame) -> DataFrame:
    """(a, b): edges whose cosine in double precision reaches the threshold."""
    near = _edges(graph).where(F.col("sim") >= THRESHOLD - SLACK).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    both = near.join(x.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(x.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array((_matrix(batch["xa"], np.float64) * _matrix(batch["xb"], np.float64)).sum(1) >= THRESHOLD)
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(check, "a long, b long")


def _cells(own: DataFrame, n: int, seed: int) -> DataFrame:
    """(root, id, x, cell, angle): each node of ``own`` (root, id, x) with its component's nearest pivot."""
    sizes = own.groupBy("root").agg(F.count("*").alias("size"))
    sized = own.join(sizes, "root").withColumn("parts", F.ceil(F.col("size") / (2 * BLOCK_NODES)).cast("int"))
    rate = F.least(F.lit(MOST_CELLS), F.ceil(F.sqrt("size") / 4)) / F.col("size")
    picked = (F.col("id") == F.col("root")) | (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < rate * (1 << 30))
    tasks = max(4, n // TASK_NODES)
    part, task = F.xxhash64("root", "part").alias("group"), F.pmod(F.xxhash64("root", "part"), F.lit(tasks)).alias("task")
    nodes_ = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select(task, part, "root", "id", "x")
    pivots = sized.where(picked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(task, part, F.col("id").alias("pivot"), F.col("x").alias("centre"))

    def assign(t: pa.Table, centres: pa.Table) -> pa.Table:
        m, c, ids = _matrix(t["x"], np.float64), _matrix(centres["centre"], np.float64), _ids(centres["pivot"])
        of = {int(_ids(centres["group"])[at[0]]): at for at in _groups(_ids(centres["group"]))}
        group, cell, angle = _ids(t["group"]), np.zeros(len(t), np.int64), np.zeros(len(t))
        for rows in _groups(group):
            at = of[int(group[rows[0]])]
            sims = m[rows] @ c[at].T
            best = sims.argmax(1)
            cell[rows], angle[rows] = ids[at][best], np.arccos(np.clip(sims[np.arange(len(rows)), best], -1, 1))
        return t.select(["root", "id", "x"]).append_column("cell", pa.array(cell)).append_column("angle", pa.array(angle))

    return nodes_.groupBy("task").cogroup(pivots.groupBy("task")).applyInArrow(assign, "root long, id long, x binary, cell long, angle double")


def _near_cells(cells: DataFrame) -> DataFrame:
    """(ca, cb, ra, rb): cells (cell, root, radius, x) of two components that may hold a link."""
    parts = max(1, -(-cells.count() // BLOCK_CELLS))
    dealt = cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    dealt = dealt.select("cell", "root", "radius", "x", "part", F.explode(mates).alias("pair"))

    def near(t: pa.Table) -> pa.Table:
        cell, root, part, r, m = _ids(t["cell"]), _ids(t["root"]), _ids(t["part"]), t["radius"].to_numpy(), _matrix(t["x"], np.float64)
        out = []
        for i in range(len(t)):  # a row at a time: only what may link takes space
            may = np.arccos(np.clip(m @ m[i], -1, 1)) <= r + r[i] + np.arccos(THRESHOLD) + 1e-6
            # two parts: those inside one are met in their own group
            may &= (root != root[i]) & ((part > part[i]) if part.min() != part.max() else (np.arange(len(t)) > i))
            out += [(cell[i], cell[j], root[i], root[j]) for j in np.flatnonzero(may)]
        found = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({c: pa.array(found[:, k]) for k, c in enumerate(("ca", "cb", "ra", "rb"))})

    return dealt.groupBy("pair").applyInArrow(near, "ca long, cb long, ra long, rb long")


def _tried(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): the components of ``pairs`` of cells of which any two of ``members`` (cell, id, x) link, all compared in blocks."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / (2 * BLOCK_NODES)).cast("int").alias("parts"))
    dealt = members.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "x")
    side = lambda c, p: sizes.select(F.col("cell").alias(c), F.col("parts").alias(p))
    blocks = pairs.join(side("ca", "pa"), "ca").join(side("cb", "pb"), "cb")
    blocks = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)))
    blocks = materialize(blocks.withColumn("group", F.xxhash64("ca", "cb", "i", "j")).select("group", "ca", "cb", "i", "j", "ra", "rb"), "blocks")
    one = blocks.select("group", F.col("ca").alias("cell"), F.col("i").alias("part"), F.col("ra").alias("root"), F.lit(0).alias("side"))
    two = blocks.select("group", F.col("cb").alias("cell"), F.col("j").alias("part"), F.col("rb").alias("root"), F.lit(1).alias("side"))
    rows = one.union(two).join(dealt, ["cell", "part"]).select("group", "root", "side", "x")
    tasks = max(4, blocks.count() // 16)

    def link(t: pa.Table) -> pa.Table:
        group, root, side, m, out = _ids(t["group"]), _ids(t["root"]), _ids(t["side"]), _matrix(t["x"], np.float64), set()
        for at in _groups(group):
            a, b = at[side[at] == 0], at[side[at] == 1]
            if len(a) and len(b) and (m[a] @ m[b].T >= THRESHOLD).any():
                out.add((int(root[a[0]]), int(root[b[0]])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.withColumn("task", F.pmod("group", F.lit(tasks))).groupBy("task").applyInArrow(link, "a long, b long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) with the components joined that ``links`` (a, b) name by their roots."""
    over = components(links, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("over"))
    return roots.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"))


def _bridged(x: DataFrame, graph: DataFrame, roots: DataFrame, n: int, seed: int) -> DataFrame:
    """``roots`` with the dense components joined that hold a link between them.

    A comparison keeps ``NEIGHBOURS`` entries for a node, so a node with as many
    links may have lost others. A node with fewer has room for all it meets.
    """

    def rich(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["id"]).filter(pa.array([bool((np.frombuffer(s, np.float32) >= THRESHOLD - SLACK).sum() >= NEIGHBOURS) for s in batch["sims"].to_pylist()], pa.bool_()))

    dense = graph.select("id", "sims").mapInArrow(rich, "id long")
    dense = materialize(roots.join(dense, roots["node"] == dense["id"]).select("root").distinct(), "dense")
    if dense.count() < 2:
        return roots
    own = roots.join(dense, "root", "left_semi").join(x.select(F.col("id").alias("node"), "x"), "node").select("root", F.col("node").alias("id"), "x")
    own = materialize(own, "dense")
    placed = materialize(_cells(own, n, seed), "placed")
    cells = placed.groupBy("cell", "root").agg(F.max("angle").alias("radius"), F.count("*").alias("size"))
    cells = materialize(cells.join(own.select(F.col("id").alias("cell"), "x"), "cell"), "cells")
    pairs = materialize(_near_cells(cells), "pairs")
    if pairs.isEmpty():
        return roots
    # most components that link do so in a few nodes of a cell; what is still apart is compared in full
    few = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(TRIED_NODES) / F.col("size") * (1 << 30)
    links = materialize(_tried(pairs, placed.join(cells.select("cell", "size"), "cell").where(few).select("cell", "id", "x")), "bridges")
    over = components(links, "a", "b")
    side = lambda r, o: over.select(F.col("node").alias(r), F.col("root").alias(o))
    apart = pairs.join(side("ra", "oa"), "ra", "left").join(side("rb", "ob"), "rb", "left").where(F.coalesce("oa", "ra") != F.coalesce("ob", "rb"))
    links = links.union(materialize(_tried(apart.select("ca", "cb", "ra", "rb"), placed.select("cell", "id", "x")), "bridges"))
    return _joined(roots, links)


def _counts(x: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, linked): rows that each node links with directly, counted inside its component, by tasks of about ``TASK_NODES`` rows."""
    own = roots.join(x.select("id", "n", "x"), roots["node"] == x["id"]).select("root", "id", "n", "x")
    sizes = materialize(roots.groupBy("root").agg(F.count("*").alias("size"), F.ceil(F.count("*") / (2 * BLOCK_NODES)).cast("int").alias("parts")), "sizes")
    rows = sizes.agg(F.coalesce(F.sum(F.col("size") * F.col("parts")), F.lit(0))).first()[0]
    own = own.join(sizes.drop("size"), "root").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # every part meets every part once; a row says on which side it stands
    mates = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    dealt = own.select("root", "id", "n", "x", "part", F.explode(mates).alias("pair")).withColumn("group", F.xxhash64("root", "pair"))
    tasks = max(4, rows // TASK_NODES)

    def count(t: pa.Table) -> pa.Table:
        group, ids, weight, part, m = _ids(t["group"]), _ids(t["id"]), _ids(t["n"]), _ids(t["part"]), _matrix(t["x"], np.float64)
        out_ids, out_n = [], []
        for rows in _groups(group):
            linked = m[rows] @ m[rows].T >= THRESHOLD
            np.fill_diagonal(linked, False)
            parts = part[rows]
            if parts.min() != parts.max():  # two parts: those inside are counted in their own group
                linked &= parts[:, None] != parts[None, :]
            out_ids.append(ids[rows])
            out_n.append(linked @ weight[rows])
        return pa.table({"id": pa.array(np.concatenate(out_ids)), "linked": pa.array(np.concatenate(out_n).astype(np.int64))})

    dealt = dealt.withColumn("task", F.pmod("group", F.lit(tasks))).groupBy("task").applyInArrow(count, "id long, linked long")
    return dealt.groupBy("id").agg(F.sum("linked").alias("linked"))


def _gained(graph: DataFrame) -> float:
    """Share of the nodes with few links that have a new one; nodes of dense groups always gain some and don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked = gained = 0
        for batch in batches:
            for sims, news in zip(batch["sims"].to_pylist(), batch["news"].to_pylist()):
                near = np.frombuffer(sims, np.float32) >= THRESHOLD - SLACK
                if 0 < near.sum() < NEIGHBOURS:
                    linked += 1
                    gained += bool(np.frombuffer(news, np.uint8)[near].any())
        yield pa.record_batch([pa.array([linked], pa.int64()), pa.array([gained], pa.int64())], ["linked", "gained"])

    row = graph.select("sims", "news").mapInArrow(run, "linked long, gained long").agg(F.sum("linked").alias("linked"), F.sum("gained").alias("gained")).first()
    return row["gained"] / row["linked"] if row["linked"] else 0.0


def audit(x: DataFrame, graph: DataFrame, roots: DataFrame, seed: int) -> tuple[float | None, float | None]:
    """Share of the linked nodes whose component holds all their links: of those with few known links, and with many.

    Up to ``AUDITED`` nodes with no, few and many known links each are compared
    with all; None where no node of the sample has a link.
    """

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = np.array([(np.frombuffer(s, np.float32) >= THRESHOLD - SLACK).sum() for s in batch["sims"].to_pylist()], np.int64)
            yield pa.record_batch([batch["id"], pa.array((links > 0).astype(np.int32) + (links >= NEIGHBOURS))], ["node", "kind"])

    kinds = graph.select("id", "sims").mapInArrow(known, "node long, kind int")
    own = x.select("id").join(kinds, F.col("id") == F.col("node"), "left").select("id", F.coalesce("kind", F.lit(0)).alias("kind"))
    own = own.join(roots, F.col("id") == F.col("node"), "left").select("id", "kind", F.coalesce("root", "id").alias("root"))
    own = materialize(own, "kinds")
    sizes = {r["kind"]: r["count"] for r in own.groupBy("kind").count().collect()}
    if not sizes:
        return None, None
    rooted = own.select(F.col("id").alias("node"), "kind", "root").join(x.select("id", "x"), F.col("node") == F.col("id")).select("id", "kind", "root", "x")
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    parts = [rooted.where((F.col("kind") == k) & (place < min(1.0, AUDITED / size) * (1 << 30))).limit(2 * AUDITED) for k, size in sorted(sizes.items())]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.union(part)
    sample = sample.toPandas()
    if sample.empty:
        return None, None
    shared = x.sparkSession.sparkContext.broadcast((sample["id"].to_numpy(np.int64), sample["root"].to_numpy(np.int64), np.stack([np.frombuffer(v, np.float64) for v in sample["x"]])))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, root, m = shared.value
        linked, held = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                near = (_matrix(batch["x"], np.float64) @ m.T >= THRESHOLD) & (_ids(batch["id"])[:, None] != ids[None])
                linked += near.sum(0)
                held += (near & (_ids(batch["root"])[:, None] == root[None])).sum(0)
        at = np.flatnonzero(linked)
        yield pa.record_batch([pa.array(ids[at]), pa.array(linked[at]), pa.array(held[at])], ["id", "linked", "held"])

    true = rooted.select("id", "root", "x").mapInArrow(brute, "id long, linked long, held long").groupBy("id").agg((F.sum("linked") == F.sum("held")).alias("whole")).toPandas()
    kind = dict(zip(sample["id"], sample["kind"]))
    weight = {k: size / max(1, (sample["kind"] == k).sum()) for k, size in sizes.items()}
    out = []
    for which in ((0, 1), (2,)):
        found = [(weight[kind[i]], whole) for i, whole in zip(true["id"], true["whole"]) if kind[i] in which]
        out.append(sum(w for w, whole in found if whole) / sum(w for w, _ in found) if found else None)
    return out[0], out[1]


def _in_full(x: DataFrame, n: int) -> DataFrame:
    """(node, root) by comparing every two blocks of nodes: the exact components, at a cost that grows with the square of ``n``."""
    parts = max(1, -(-n // BLOCK_CELLS))
    dealt = x.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))

    def span(t: pa.Table) -> pa.Table:
        ids, m = _ids(t["id"]), _matrix(t["x"], np.float64)
        linked, label = m @ m.T >= THRESHOLD, np.arange(len(t))
        np.fill_diagonal(linked, True)
        while True:  # the least row that links reach inside the block
            new = np.where(linked, label[None, :], len(t)).min(1)
            if (new == label).all():
                break
            label = new
        at = label != np.arange(len(t))
        return pa.table({"a": pa.array(ids[at]), "b": pa.array(ids[label[at]])})

    links = dealt.select("id", "x", F.explode(mates).alias("pair")).groupBy("pair").applyInArrow(span, "a long, b long")
    return components(links, "a", "b")


def _few(x: DataFrame) -> DataFrame:
    """(id, root, linked) of nodes of lengths that have up to ``FULL_NODES`` nodes each, all of a length compared."""

    def compare(t: pa.Table) -> pa.Table:
        ids, m, weight = _ids(t["id"]), _matrix(t["x"], np.float64), _ids(t["n"])
        linked, label = m @ m.T >= THRESHOLD, np.arange(len(t))
        np.fill_diagonal(linked, False)
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], len(t)).min(1))
            if (new == label).all():
                break
            label = new
        return pa.table({"id": pa.array(ids), "root": pa.array(ids[label]), "linked": pa.array((linked @ weight).astype(np.int64))})

    return x.groupBy("d").applyInArrow(compare, "id long, root long, linked long")


def _searched(x: DataFrame, seed: int) -> DataFrame:
    """(id, root, linked) of nodes (id, n, x) of one length, by NN-descent."""
    n = x.count()
    graph, roots, recall = None, None, 0.0
    for again in range(PASSES):
        graph = materialize(_merge(_by_codes(x, n, seed + again), graph), "graph")
        lost = _gained(graph) if again else 1.0
        for r in range(MOST_ROUNDS):
            graph = _round(x, graph, n, seed + 10 * again + r)
            if r + 1 >= (ROUNDS_LATER if again else ROUNDS) and _gained(graph) < CHANGED:
                break
        if not again:  # what the first codes have lost only others can tell
            continue
        roots = materialize(components(_links(x, graph), "a", "b"), "roots")
        roots = materialize(_bridged(x, graph, roots, n, seed + again), "roots")
        # a sample without links is no evidence; what fresh codes find is
        small, dense = audit(x, graph, roots, seed + again)
        recall = min([1 - lost, *(share for share in (small, dense) if share is not None)])
        _LOG.info("pass %d over %d nodes: new links for %.4f of those with few; whole by audit: %s with few, %s with many", again, n, lost, small, dense)
        if recall >= WANTED_RECALL:
            break
    if recall < LEAST_RECALL:
        _LOG.warning("recall %.3f stays below %.3f: all blocks are compared", recall, LEAST_RECALL)
        roots = materialize(_in_full(x, n), "roots")
    found = x.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").join(_counts(x, roots), "id", "left")
    return found.select("id", F.coalesce("root", "id").alias("root"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"))


def near_duplicates(vectors: DataFrame, seed: int = 5) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    ids = vectors.select("vec_id")
    members, x = nodes(vectors)
    lengths = materialize(x.groupBy("d").agg(F.count("*").alias("nodes")), "lengths")
    most = lengths.orderBy(F.desc("nodes"), "d").first()
    large = sorted({most["d"], *(r["d"] for r in lengths.where(F.col("nodes") > FULL_NODES).collect())}) if most else []
    found = _few(x.where(~F.col("d").isin(large)))
    for d in large:
        found = found.unionByName(_searched(x.where(F.col("d") == d).select("id", "n", "x"), seed))
    grouped = materialize(x.select("id", "least_id", "n").join(found, "id"), "grouped")
    least = materialize(grouped.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    per_node = grouped.join(least, "root").select(F.col("id").alias("node"), (F.col("linked") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = members.join(per_node, "node").select("vec_id", "n_links", "component_id")
    sound = linked.groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("sound"))
    total = ids.groupBy("vec_id").agg(F.count("*").alias("all"))
    # rows without a usable vector: as many as an id has beyond its sound ones
    rest = total.join(sound, total["vec_id"].eqNullSafe(sound["id"]), "left").select("vec_id", F.explode(F.array_repeat(F.lit(0), (F.col("all") - F.coalesce("sound", F.lit(0))).cast("int"))).alias("n_links"))
    out = linked.unionByName(rest.select("vec_id", F.col("n_links").cast("long"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
