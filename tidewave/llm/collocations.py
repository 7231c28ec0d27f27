"""Operator 11: phrases of words that stick together, mined by growing prefixes.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words
at spaces and tabs. Per language, a phrase of 2 to 4 words that occurs often
enough is a candidate. Its score compares it with its two parts at the cut where
it sticks together least.

Mining follows PrefixSpan (Pei et al. 2001) for contiguous patterns:

1. Words are counted, then neighbouring pairs of frequent words, then triples of
   frequent pairs, each by partial sums. Pairs and triples are known by hashes
   here; they only serve as filters, as the matrices of PrefixSpan's bi-level
   projection do.
2. Each occurrence of a frequent pair is projected: the pair and the words behind
   it, as far as the filters allow, summed up before and in the shuffle. Each
   prefix is one task's group. A prefix with more than ``MOST_POINTERS`` different
   continuations is dealt out by its third word instead, and its parts are summed.
3. A task walks through its prefixes and extends each to the right, depth first:
   pointers that continue with the same word are the projection of the longer
   prefix; it goes on while the phrase is frequent. These counts are exact.

Words are told apart by 64-bit hashes of language and word. Null texts are empty,
a null language counts as ``und``; rows that repeat count again; ties are kept up
to the last rank's order by phrase. Texts of any length are taken whole. An empty
table gives none; columns beyond text and lang aren't read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import _BASE, _BYTE_LOWER, _DOWN, _UP, RUN_BYTES, Filter, discard, materialize, mix

#: A candidate occurs so often, and has so many words at most.
LEAST, LONGEST = 30, 4
#: A candidate goes if a longer one holds it and has so many percent of its occurrences.
HELD_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
#: Words that are summed up before they are sent.
BATCH_WORDS = 1 << 18
MOST_POINTERS = 200_000
#: Parts that hot keys of lookups are dealt out to; candidates of one part of a language's ranking.
SALTS, RANKED = 8, 200_000
#: Up to so many hot prefixes are broadcast.
MOST_HOT = 100_000

_APART = np.zeros(256, np.uint8)
_APART[[9, 32]] = 1
_APART[[*b".,;:!?", *range(10, 14)]] = 2
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_KEY = ["c1", "c2", "c3", "c4"]


class Words:
    """Words of some texts: ``codes`` and ``lang`` of all, where they are in ``data``, and whether the next one follows in the same piece."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], data: np.ndarray):
        self.data = data
        self.codes, self.lang, self.text, self.starts, self.stops, self.joint = (np.concatenate(x) for x in zip(*parts))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; those of words without so many followers mean nothing."""
        h = np.zeros(len(self.codes), np.uint64)
        for j in range(n):
            h = h * np.uint64(_BASE) + np.concatenate([self.codes[j:], np.zeros(min(j, len(h)), np.uint64)])
        return mix(h)

    def together(self, ok: np.ndarray) -> np.ndarray:
        """Where ``ok`` holds for a word and the next one of its piece."""
        return ok & self.joint & np.concatenate([ok[1:], [False]])[: len(ok)]


def _lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes, texts, starts, stops of words, and whether the next word is in the same piece."""
    apart = _APART[data]
    solid = apart == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    stops = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * _UP.upto(len(data)), out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * _DOWN.upto(len(data) + 1)[starts] + (stops - starts).astype(np.uint64))
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(apart == 2)[starts]
    joint = np.zeros(len(starts), bool)
    joint[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return hashes, text, starts, stops, joint


def words(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch (text, lang), about ``BATCH_WORDS`` at a time; texts stay whole."""
    texts = batch["text"].cast(pa.large_string()).fill_null("")
    langs = batch["lang"].dictionary_encode()
    known = np.array([_lang_code(x) for x in langs.dictionary.to_pylist()], np.uint64)
    lang = known[langs.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at, parts, held = 0, [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1)
        hashes, text, starts, stops, joint = _cut(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        own = lang[at + text]
        parts.append((mix(hashes ^ own), own, at + text, offsets[at] + starts, offsets[at] + stops, joint))
        held += len(hashes)
        at = to
        if held >= BATCH_WORDS or at == len(texts):
            yield Words(parts, data)
            parts, held = [], 0


def _summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how often each is there."""
    return np.unique(rows, return_counts=True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counted(docs: DataFrame, keys: Callable[[Words], np.ndarray]) -> DataFrame:
    """(key, n): the 64-bit keys that ``keys`` gives for at least ``LEAST`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch):
                key, n = _summed(keys(w))
                yield pa.record_batch([_signed(key), pa.array(n)], ["key", "n"])

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _frequent_words(docs: DataFrame) -> DataFrame:
    """(g, c1, lang, word, n): frequent words; a null word stands for all words of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch):
                _, first, n = np.unique(w.codes, return_index=True, return_counts=True)
                size = w.stops[first] - w.starts[first]
                ends = np.concatenate([[0], np.cumsum(size)])
                letters = _TO_LOWER[w.data[np.repeat(w.starts[first] - ends[:-1], size) + np.arange(ends[-1])]]
                found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(letters)).cast(pa.string())
                yield pa.record_batch([batch["lang"].take(pa.array(w.text[first])), found, pa.array(n)], ["lang", "word", "n"])
                text, n = _summed(w.text)
                yield pa.record_batch([batch["lang"].take(pa.array(text)), pa.nulls(len(text), pa.string()), pa.array(n)], ["lang", "word", "n"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, g = np.zeros(len(batch), np.uint64), np.array([_lang_code(x) for x in batch["lang"].to_pylist()], np.uint64)
            for w in words(pa.record_batch([batch["word"], batch["lang"]], ["text", "lang"])):
                code[w.text] = w.codes
            yield pa.RecordBatch.from_arrays([_signed(g), _signed(code), *batch.columns], names=["g", "c1", *batch.schema.names])

    counted = docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= LEAST) | F.col("word").isNull()).mapInArrow(coded, "g long, c1 long, lang string, word string, n long")


def _shared(keys: DataFrame, column: str):
    return keys.sparkSession.sparkContext.broadcast(Filter.of(keys, column))


def _projected(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(g, c1 to c4, n): pairs that may be frequent with the words behind them, as far as they may be (0: no further)."""
    one = _shared(frequent.where("word is not null"), "c1")

    def pairs(w: Words) -> np.ndarray:
        return w.grams(2)[w.together(one.value.may_hold(w.codes))]

    two_keys = materialize(_counted(docs, pairs), "pairs")
    two = _shared(two_keys, "key")

    def paired(w: Words) -> np.ndarray:
        """Words with which a pair begins that may be frequent."""
        ok, at = np.zeros(len(w.codes), bool), np.flatnonzero(w.joint)
        ok[at] = two.value.may_hold(w.grams(2)[at])
        return ok

    def triples(w: Words) -> np.ndarray:
        return w.grams(3)[w.together(paired(w))]

    three_keys = materialize(_counted(docs, triples), "triples")
    three = _shared(three_keys, "key")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch):
                pair = paired(w)
                at = np.flatnonzero(w.together(pair))
                triple = np.zeros(len(pair), bool)
                triple[at] = three.value.may_hold(w.grams(3)[at])
                four = w.together(triple)
                start = np.flatnonzero(pair)
                rows = np.zeros((len(start), 5), np.uint64)
                rows[:, 0] = w.lang[start]
                for j, ok in enumerate((pair, pair, triple, four)):
                    on = ok[start]
                    rows[on, 1 + j] = w.codes[start[on] + j]
                # equal continuations have equal hashes; they are summed up here already
                h = np.zeros(len(rows), np.uint64)
                for j in range(1, 5):
                    h = mix(h * np.uint64(_BASE) + rows[:, j])
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.record_batch([*(_signed(np.ascontiguousarray(rows[first, j])) for j in range(5)), pa.array(n)], ["g", *_KEY, "n"])

    out = docs.mapInArrow(project, "g long, c1 long, c2 long, c3 long, c4 long, n long").groupBy("g", *_KEY).agg(F.sum("n").alias("n"))
    out = materialize(out, "projected")
    discard(two_keys, three_keys)
    return out


def grow(codes: np.ndarray, n: np.ndarray, depth: int, least: int = LEAST, whole: bool = True) -> Iterator[tuple[int, int, int]]:
    """Extend a prefix of ``depth`` words to the right, depth first; gives (a row of the phrase, its length, its count).

    ``codes`` are the sorted pointers of the prefix, ``n`` how often each is there. A
    prefix whose other pointers lie elsewhere (``whole`` is false) is given in any case.
    """
    total = int(n.sum())
    if whole and total < least:
        return
    yield 0, depth, total
    if depth == codes.shape[1]:
        return
    following = codes[:, depth]
    start = np.flatnonzero(np.concatenate([[True], following[1:] != following[:-1]]))
    sums = np.add.reduceat(n, start)
    stop = np.concatenate([start[1:], [len(n)]])
    for i in np.flatnonzero((sums >= least) & (following[start] != 0)):
        a, b = int(start[i]), int(stop[i])
        for row, size, count in grow(codes[a:b], n[a:b], depth + 1, least):
            yield a + row, size, count


def _mined(projected: DataFrame) -> DataFrame:
    """(g, c1 to c4, a): the frequent phrases of two words and more."""
    spark = projected.sparkSession
    hot = projected.groupBy("c1", "c2").count().where(F.col("count") > MOST_POINTERS).select("c1", "c2", F.lit(True).alias("hot"))
    n_hot = hot.count()
    dealt = projected.withColumn("hot", F.lit(False))
    if n_hot:
        dealt = projected.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, ["c1", "c2"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), projected.count() // (4 * MOST_POINTERS) + 1)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def grown(t: pa.Table, start: np.ndarray) -> pa.RecordBatch:
            g, n, split = (t[c].to_numpy() for c in ("g", "n", "hot"))
            codes = np.stack([t[c].to_numpy() for c in _KEY], 1)
            rows, sizes, counts = [], [], []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(n)]):
                for row, size, count in grow(codes[a:b], n[a:b], 2, whole=not split[a]):
                    rows.append(a + row)
                    sizes.append(size)
                    counts.append(count)
            at = np.array(rows, np.int64)
            kept = np.where(np.arange(LONGEST) < np.array(sizes, np.int64).reshape(-1, 1), codes[at], 0)
            return pa.record_batch([pa.array(g[at]), *(pa.array(np.ascontiguousarray(kept[:, j])) for j in range(LONGEST)), pa.array(counts, pa.int64())], ["g", *_KEY, "a"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
            if not len(t):
                continue
            c1, c2, c3, split = (t[c].to_numpy() for c in ("c1", "c2", "c3", "hot"))
            new = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (split[1:] & (c3[1:] != c3[:-1]))
            start = np.flatnonzero(np.concatenate([[True], new]))
            last = int(start[-1])  # the last prefix may go on in the next batch
            if last:
                yield grown(t.slice(0, last), start[:-1])
            left = t.slice(last)
        if left is not None:
            yield grown(left, np.zeros(1, np.int64))

    keys = ["c1", "c2", F.when(F.col("hot"), F.col("c3")).otherwise(F.lit(0))]
    found = dealt.select("g", *_KEY, "n", "hot").repartition(parts, *keys).sortWithinPartitions(*_KEY).mapInArrow(mine, "g long, c1 long, c2 long, c3 long, c4 long, a long")
    return found.groupBy("g", *_KEY).agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)


def _part(first: int, last: int) -> list[Column]:
    """Columns of the words ``first`` to ``last`` of a phrase, and zeros."""
    own = [F.col(f"c{i}") for i in range(first, last + 1)]
    return [(own[i] if i < len(own) else F.lit(0).cast("long")).alias(f"d{i + 1}") for i in range(LONGEST)]


def _size() -> Column:
    return F.lit(2) + (F.col("c3") != 0).cast("int") + (F.col("c4") != 0).cast("int")


def _exploded(phrases: DataFrame, pieces: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Rows of ``phrases`` with each (size, first, last, cut, side) of ``pieces`` that belongs to their size, as d1 to d4."""
    options = [F.when(F.col("size") == size, F.struct(*_part(a, b), F.lit(cut).alias("cut"), F.lit(side).alias("side"))) for size, a, b, cut, side in pieces]
    return phrases.select("*", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("p")).select(*phrases.columns, "p.*")


def _scored(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """Candidates that no longer one stands for, with l, r and score at the cut of the lowest score."""
    keys = ["d1", "d2", "d3", "d4"]
    sized = phrases.withColumn("size", _size())
    inside = [(size, i, i + k - 1, 0, 0) for size in (3, 4) for k in range(2, size) for i in range(1, size - k + 2)]
    held = _exploded(sized.where("size > 2"), inside).groupBy(*keys).agg(F.max("a").alias("longer"))
    on = [F.col(c) == F.col(d) for c, d in zip(_KEY, keys)]
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = sized.join(held, on, "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * HELD_PERCENT)).select(*sized.columns)
    cuts = [(size, *part, cut, side) for size in (2, 3, 4) for cut in range(1, size) for side, part in enumerate(((1, cut), (cut + 1, size)))]
    # a frequent part belongs to many candidates: its lookups are dealt out by candidate
    asked = _exploded(kept, cuts).withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(SALTS)).cast("int"))
    zero = F.lit(0).cast("long")
    known = phrases.select(*[F.col(c).alias(d) for c, d in zip(_KEY, keys)], F.col("a").alias("f")).union(frequent.where("word is not null").select("c1", zero, zero, zero, "n"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = asked.join(known, [*keys, "salt"]).groupBy("g", *_KEY, "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    value = F.expr(f"({SCALE} * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = parts.withColumn("score", value).groupBy("g", *_KEY, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("g", *_KEY, "a", "b.l", "b.r", "b.score")


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    frequent = materialize(_frequent_words(rows), "words")
    projected = _projected(rows, frequent)
    phrases = materialize(_mined(projected), "phrases")
    discard(projected)
    scored = materialize(_scored(phrases, frequent), "scored")
    discard(phrases)
    # ranks with ties in parts of a language first, so that no task gets all of it
    salts = max(SALTS, scored.count() // RANKED)
    order = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(salts)))
    for keys in (["g", "salt"], ["g"]):
        near = near.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    columns = ["g", *_KEY, "a", "l", "r", "score"]
    spelled = near.select(*columns, F.posexplode(F.filter(F.array(*_KEY), lambda c: c != 0)).alias("pos", "code"))
    word = frequent.where("word is not null").select(F.col("c1").alias("code"), "word")
    spelled = spelled.join(word, "code").groupBy(*columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = frequent.where("word is null").select("g", "lang", "n")
    ranked = spelled.join(total, "g").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_CUTS = "SELECT c.*, k, array_to_string(p[1:k], ' ') AS first_part, array_to_string(p[k + 1:], ' ') AS rest FROM (SELECT *, string_split(phrase, ' ') AS p FROM kept) c, range(1, 4) t(k) WHERE k < size"

ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) t(size) WHERE len(w) >= size),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT * FROM f WHERE size > 1 AND a >= {LEAST}),
longer AS (SELECT lang, array_to_string(p[i:i + k - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, string_split(phrase, ' ') AS p FROM cand) c, range(1, {LONGEST}) t(i), range(2, {LONGEST}) u(k) WHERE k < size AND i + k - 1 <= size GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < {HELD_PERCENT} * a::HUGEINT),
cuts AS ({_CUTS}),
valued AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * c.a) // (l.a + r.a) AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = first_part JOIN f r ON r.lang = c.lang AND r.phrase = rest),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
