"""Operator 2: n-gram Jaccard join by filtering under several global token orders.

Texts are sets of shingles (five words, A-Z lower-cased). Two sets of sizes
m <= n with a Jaccard similarity of t must share a token in the first
``n - ceil(t n) + 1`` tokens of the larger and the first
``m - ceil(2 t / (1 + t) m) + 1`` of the smaller, under any global order.

1. The first order puts frequent tokens last. Texts that share such prefix
   tokens under it are candidates, if their sizes and the token's places leave
   room for so many common tokens.
2. Only for texts that are in a candidate pair an outline (tokens per hash cell)
   is made; pairs whose outlines leave no room go. For what is left prefixes
   under two more orders are made; pairs that miss each other under one of the
   orders go.
3. Only for the pairs that all orders let through the whole sets travel, and
   the common shingles are counted.

Copies form one class. What is joined are classes, first with two classes of
each prefix token (that with the fewest rare tokens, and the greatest), then,
where a token still has classes that are not connected, with all of those: so
the components come out whole while a large group of near copies never expands
into all its pairs. A token of very many classes is dealt out in groups, each
with two such classes.

An empty table gives an empty result. Null texts and texts without words have
an empty set and link with nothing. Texts of any length are taken whole. Rows
of equal text are linked with each other; a repeated id is treated as so many
rows and gets the smallest id that any of them reaches; null ids are kept and
never the smallest. Only doc_id and text are read: further columns may have any
name. Sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from tidewave.llm.common import NGRAM, SIMILAR_PERCENT, Filter, arrow_rows, components, discard, materialize, mix, plain_names, runs, shingle_sets, unused

#: Further token orders, by the seed that permutes the hashes.
ORDERS = (0x5BD1E995, 0xC2B2AE3D)
#: A token is a candidate for the table of frequent ones from so many among the sets on, counted in runs of about so many tokens.
LOCAL_FREQUENT, LOCAL_TOKENS = 2, 1 << 21
#: Bound of that broadcast table (24 bytes each).
MOST_FREQUENT = 1 << 19
#: A token of more classes is dealt out in groups of about so many.
GROUP_ROWS = 20_000
#: So many classes a task remembers at most, to leave out copies early.
SEEN_CLASSES = 1 << 17
#: Texts of a batch in a Python worker.
ARROW_ROWS = 2000
#: Stands for a null id where wanted rows are looked up.
NO_ID = -(1 << 63)


def _class_of(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    salted = mix(s ^ np.uint64(0xA0761D6478BD642F))
    return int(mix(np.array([salted.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_length(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """So many first tokens of a set it must share one of with any similar set that isn't larger."""
    return size - (size * percent + 99) // 100 + 1


def index_length(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """So many first tokens of a set it must share one of with any similar set that isn't smaller."""
    return size + (-2 * percent * size) // (100 + percent) + 1


#: Cells of an outline: how many tokens of a set fall into each.
CELLS = 256


def _outline(s: np.ndarray) -> bytes:
    """The cells' counts, of four bits each where they all fit, else of eight, at most 255."""
    n = np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8)
    return (n[::2] << np.uint8(4) | n[1::2]).tobytes() if n.max() < 16 else n.tobytes()


def _cells(outline: pa.Scalar) -> np.ndarray:
    n = np.frombuffer(outline.as_buffer(), np.uint8)
    return n if len(n) == CELLS else np.stack([n >> np.uint8(4), n & np.uint8(15)], 1).ravel()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, classes = [], []
        for _, run in runs(batch["text"], lower=True):
            for s in shingle_sets(run):
                sizes.append(len(s))
                classes.append(_class_of(s) if len(s) else None)
        yield pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], ["doc_id", "n", "class"])


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many texts have, in order of frequency, and in how many; bounded by ``MOST_FREQUENT``.

    They only shape the order: any table gives the same links.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0

        def count() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            keep = n >= LOCAL_FREQUENT
            return pa.record_batch([pa.array(token[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

        for batch in batches:
            for _, run in runs(batch["text"], lower=True):
                for s in shingle_sets(run):
                    if len(s) and (c := _class_of(s)) not in sets:
                        sets[c], size = s, size + len(s)
                if size >= LOCAL_TOKENS:
                    yield count()
                    sets, size = {}, 0
        yield count()

    counted = docs.select("text").mapInArrow(local, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "frequent")
    levels = counted.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("level")).agg(F.count("*").alias("tokens")).orderBy(F.desc("level")).collect()
    total, least = 0, 1 << 30
    for row in levels:  # one row for each quarter power of two
        total += row["tokens"]
        if total > MOST_FREQUENT:
            break
        least = row["level"]
    found = counted.where(F.floor(F.log2("n") * 4) >= least).toPandas()
    discard(counted)
    found = found.sort_values(["n", "token"])
    return found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)


def _order(s: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sort key of each token under the first order: frequent tokens last, by rank."""
    key = mix(s) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        hit = frequent[at] == s
        key[hit] = ranks[at[hit]] + np.uint64(1 << 63)
    return key


def _first(s: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` tokens of a set in the order of their keys."""
    some = np.argpartition(key, n - 1)[:n] if n < len(s) else np.arange(len(s))
    return s[some[np.argsort(key[some])]]


def _postings(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray, percent: int) -> DataFrame:
    """(token, part, parts, class, n, at, rare) for the prefix tokens of each set; copies that a task meets soon again are left out.

    ``at``: the token's place in the set's order; ``rare``: how many of the prefix are not frequent, so 0 for what others are edited copies of;
    ``part`` of ``parts``: the group of a token that many classes have.
    """
    by_value = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_value], by_value.astype(np.uint64), (counts[by_value] // GROUP_ROWS + 1).astype(np.int32)))

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, ranks, groups), seen = shared.value, set()
        for batch in batches:
            if len(seen) > SEEN_CLASSES:
                seen.clear()
            for _, run in runs(batch["text"], lower=True):
                classes, tokens, sizes, rare = [], [], [], []
                for s in shingle_sets(run):
                    if len(s) and (c := _class_of(s)) not in seen:
                        seen.add(c)
                        key = _order(s, known, ranks)
                        classes.append(c)
                        tokens.append(_first(s, key, prefix_length(len(s), percent)))
                        rare.append(min(len(tokens[-1]), int((key < np.uint64(1 << 63)).sum())))
                        sizes.append(len(s))
                if not tokens:
                    continue
                n, token = np.array([len(t) for t in tokens]), np.concatenate(tokens)
                at = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
                owner = np.repeat(np.array(classes, np.int64), n)
                parts = np.ones(len(token), np.int32)
                if len(known):
                    where = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    parts = np.where(known[where] == token, groups[where], parts)
                part = (owner.view(np.uint64) % parts.astype(np.uint64)).astype(np.int32)
                columns = [pa.array(token.view(np.int64)), pa.array(part), pa.array(parts), pa.array(owner), pa.array(at, pa.int32()), pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(np.repeat(np.array(rare, np.int32), n))]
                yield pa.record_batch(columns, ["token", "part", "parts", "class", "at", "n", "rare"])

    return docs.select("text").mapInArrow(run_all, "token long, part int, parts int, class long, at int, n int, rare int")


def _wanted(docs: DataFrame, pairs: DataFrame, owners: DataFrame, make, shape: str) -> DataFrame:  # noqa: ANN001
    """What ``make`` gives for each set (class first) of the texts that own a class of ``pairs`` (a few others may come too)."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(owners, "class")
    wanted = materialize(wanted.select(F.coalesce("owner", F.lit(NO_ID)).alias("key")), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(Filter.of(wanted, "key"))
    discard(wanted)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.flatnonzero(shared.value.may_hold(ids.view(np.uint64)))
            seen = set()
            for at, run in runs(batch["text"].take(pa.array(rows)), lower=True):
                sets = [(i, c, s) for i, s in enumerate(shingle_sets(run), at) if len(s) and ((c := _class_of(s)), ids[rows[i]]) not in seen]
                seen.update((c, ids[rows[i]]) for i, c, _ in sets)
                if sets:
                    yield make([None if ids[rows[i]] == NO_ID else ids[rows[i]] for i, _, _ in sets], [c for _, c, _ in sets], [s for _, _, s in sets])

    return docs.mapInArrow(run_all, shape)


def _with_both(pairs: DataFrame, owners: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``found`` for the owners of both classes, named by their side.

    The owners come first, so that what is found for ``a`` travels once with the pair.
    """
    for side in ("a", "b"):
        pairs = pairs.join(owners.select(F.col("class").alias(side), F.col("owner").alias(f"__{side}")), side)
    for side in ("a", "b"):
        own = found.select(F.col("doc_id").alias("__id"), F.col("class").alias("__class"), *[F.col(c).alias(f"{c}_{side}") for c in found.columns if c not in ("doc_id", "class")])
        pairs = pairs.join(own, (F.col(side) == F.col("__class")) & F.col(f"__{side}").eqNullSafe(F.col("__id"))).drop("__id", "__class")
    return pairs


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), kind))


def _roomy(docs: DataFrame, pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) whose outlines leave room for so many common tokens; none that are similar go."""

    def make(ids: list, classes: list, sets: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array([_outline(s) for s in sets], pa.binary())], ["doc_id", "class", "n", "outline"])

    outlines = _wanted(docs, pairs, owners, make, "doc_id long, class long, n int, outline binary")
    both = _with_both(pairs, owners, outlines)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.stack([_cells(o) for o in batch[c]]) for c in ("outline_a", "outline_b"))
                least = np.minimum(x, y)
                room = least.sum(1, dtype=np.int64)
                room[(least == 255).any(1)] = 1 << 40  # a full cell tells nothing
                size = batch["n_a"].to_numpy().astype(np.int64) + batch["n_b"].to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(100 * room >= percent * (size - room)))

    return both.select("a", "b", "n_a", "n_b", "outline_a", "outline_b").mapInArrow(check, "a long, b long").distinct()


def meeting(docs: DataFrame, pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) that also share prefix tokens under each of the further orders; none that are similar go."""

    def make(ids: list, classes: list, sets: list) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(list(map(len, sets)), pa.int32())]
        for seed in ORDERS:  # 16 bits of a token: a chance meeting lets a pair through, none is lost
            columns.append(_lists([_first(s, mix(s ^ np.uint64(seed)), prefix_length(len(s), percent)).astype(np.uint16).view(np.int16) for s in sets], pa.int16()))
        return pa.record_batch(columns, ["doc_id", "class", "n", *[f"order{i}" for i in range(len(ORDERS))]])

    prefixes = _wanted(docs, pairs, owners, make, "doc_id long, class long, n int, " + ", ".join(f"order{i} array<smallint>" for i in range(len(ORDERS))))
    both = _with_both(pairs, owners, prefixes)

    def shares(order: str) -> Column:
        def part(side: str, other: str) -> Column:  # the smaller set's prefix is the shorter one
            n = F.col(f"n_{side}")
            least = n - F.ceil(2 * percent * n / (100 + percent)).cast("int") + 1
            return F.slice(f"{order}_{side}", F.lit(1), F.when(n <= F.col(f"n_{other}"), least).otherwise(n))

        return F.arrays_overlap(part("a", "b"), part("b", "a"))

    for i in range(len(ORDERS)):
        both = both.where(shares(f"order{i}"))
    return both.select("a", "b").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) that pass all orders and are similar."""
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    roomy = materialize(_roomy(docs, pairs, owners, percent), "pairs")
    discard(pairs)
    if roomy.isEmpty():
        return roomy
    met = materialize(meeting(docs, roomy, owners, percent), "met")
    discard(roomy)
    if met.isEmpty():
        return met

    def make(ids: list, classes: list, sets: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), _lists([s.view(np.int64) for s in sets], pa.int64())], ["doc_id", "class", "tokens"])

    sets = _wanted(docs, met, owners, make, "doc_id long, class long, tokens array<bigint>")
    both = _with_both(met, owners, sets)
    both = both.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    similar = 100 * F.col("common") >= percent * (F.size("tokens_a") + F.size("tokens_b") - F.col("common"))
    links = materialize(both.where(similar).select("a", "b").distinct(), "links")
    discard(met)
    return links


def _may(a: str, b: str, percent: int) -> Column:
    """Whether two sets (columns ``n`` and ``at`` of ``a`` and ``b``) that first meet in a token can be similar.

    What they share then stands at or behind that token in both orders. Pairs
    that are similar pass at the first token they share.
    """
    both = (F.col(f"{a}n") + F.col(f"{b}n")) * percent
    return ((F.col(f"{a}n") - F.col(f"{a}at")) * (100 + percent) >= both) & ((F.col(f"{b}n") - F.col(f"{b}at")) * (100 + percent) >= both)


def _owners(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class) of all rows, and (class, owner): the smallest id of each class."""
    members = materialize(docs.mapInArrow(_digests, "doc_id long, n long, class long"), "members")
    return members, materialize(members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("owner")), "owners")


def _shared(docs: DataFrame, percent: int) -> DataFrame:
    """The postings of tokens that several classes have, each with two classes (``low``, ``high``) of its group of the token."""
    by_token = Window.partitionBy("token", "part")
    low, high = F.min(F.struct("rare", "class", "n", "at")).over(by_token), F.max(F.struct("class", "n", "at")).over(by_token)
    several = (F.min("class").over(by_token) < F.max("class").over(by_token)) | (F.col("parts") > 1)
    again = F.lag("class").over(by_token.orderBy("class")) == F.col("class")  # a copy in another batch
    postings = _postings(docs, *_frequent(docs), percent).withColumn("again", again).where(F.coalesce(~F.col("again"), F.lit(True)))
    # a token that one class has alone leads nowhere; one shuffle by token finds the ends of the others
    return postings.withColumns({"low": low, "high": high, "several": several}).where("several").select("token", "parts", "class", "n", "at", "low", "high")


def _stars(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class with the two of its group, and of the groups of one token with each other."""
    to_low = shared.where((F.col("class") != F.col("low.class")) & _may("", "low.", percent)).select(F.col("low.class").alias("a"), F.col("class").alias("b"))
    to_high = shared.where((F.col("class") != F.col("high.class")) & _may("", "high.", percent)).select(F.col("class").alias("a"), F.col("high.class").alias("b"))
    groups = shared.where("parts > 1").select("token", "low").distinct()
    among = groups.join(groups.groupBy("token").agg(F.min("low").alias("first")), "token").where((F.col("low.class") != F.col("first.class")) & _may("low.", "first.", percent))
    return to_low.union(to_high).union(among.select(F.col("first.class").alias("a"), F.col("low.class").alias("b"))).distinct()


def _open(labelled: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components (column ``root``) at tokens where there are several."""
    split = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    left = materialize(labelled.join(split, "token"), "open")
    n = F.col("n")
    indexed = left.where(F.col("at") < n - F.ceil(2 * percent * n / (100 + percent)) + 1)
    x = indexed.select("token", F.col("class").alias("a"), F.col("n").alias("an"), F.col("at").alias("aat"), F.col("root").alias("ra"))
    y = left.select("token", F.col("class").alias("b"), F.col("n").alias("bn"), F.col("at").alias("bat"), F.col("root").alias("rb"))
    found = x.join(y, "token").where((F.col("an") <= F.col("bn")) & (F.col("ra") != F.col("rb")) & _may("a", "b", percent))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join(docs: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, and ``set_class``, equal for equal sets."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _joined(docs.select(F.col("doc_id").cast("long"), "text"), percent)


def _joined(docs: DataFrame, percent: int) -> DataFrame:
    members, owners = _owners(docs)
    shared = materialize(_shared(docs, percent), "shared")
    links = _verified(docs, _stars(shared, percent), owners, percent)
    labels = components(links, "a", "b")
    labelled = shared.select("token", "class", "n", "at").join(labels.withColumnRenamed("node", "class"), "class", "left")
    labelled = materialize(labelled.select("token", "class", "n", "at", F.coalesce("root", "class").alias("root")), "labelled")
    discard(shared)
    more = _verified(docs, _open(labelled, percent), owners, percent)
    discard(labelled)
    roots = components(labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")
    grouped = owners.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    grouped = materialize(grouped, "grouped")
    smallest = grouped.groupBy("root").agg(F.min("owner").alias("component_id"))
    by_class = grouped.join(smallest, "root").select("class", "component_id", "root")
    out = members.join(by_class, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("class").alias("set_class"), F.col("root").alias("group"))


def keep_one(docs: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``docs`` with one row of each component; rows without words all stay.

    It is the row of the smallest id (a null id only where there is no other);
    of several with this id that of the smallest hash over its columns. Further
    columns may have any name.
    """
    return _one_each(plain_names(docs), percent).toDF(*docs.columns)


def _one_each(docs: DataFrame, percent: int) -> DataFrame:
    found = join(docs, percent).where("set_class is not null")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_class")).alias("first"))
    first = materialize(first.select(F.col("first.doc_id").alias("__id"), F.col("first.set_class").alias("__set")), "first")
    row, own = unused("row", docs.columns), unused("class", docs.columns)
    kinds = StructType([*docs.schema.fields, StructField(own, LongType())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [_class_of(s) if len(s) else None for _, run in runs(batch["text"], lower=True) for s in shingle_sets(run)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.int64())], names=[*batch.schema.names, own])

    known = docs.mapInArrow(classify, kinds)
    kept = known.join(first, (F.col(own) == F.col("__set")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    hashed = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    kept = kept.groupBy(own).agg(F.min_by(F.struct(*docs.columns), hashed).alias(row)).select(f"{row}.*")
    return kept.unionByName(known.where(F.col(own).isNull()).drop(own))


ORACLE = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {NGRAM} THEN list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i:i + {NGRAM - 1}], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {SIMILAR_PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets
"""
