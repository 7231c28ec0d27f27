"""Operator 4: removal of repeated passages with sharded Aho-Corasick automata.

A window is 20 consecutive words of one document; a word goes when a window
over it also starts earlier (smaller id, or same document and earlier start).

1. Of each window the 8-word phrase with the smallest hash is its anchor, so
   equal windows have equal anchors. Anchors that occur twice are counted.
2. Windows over recurring anchors are hashed and dealt out by hash, packed in
   arrays, each with its anchor phrase; where a window recurs, it is confirmed,
   and the place where it starts first is noted. The dictionary of confirmed
   phrases is sharded: each block of documents (by hash of the id) gets those
   phrases and windows that occur in it.
3. Each block compiles its shard into an Aho-Corasick automaton and streams all
   its documents through it. The automaton alone says where to look: of the
   windows around each hit those that are confirmed, and do not start there
   first, go.

A task holds one block (about ``BLOCK_CHARS`` of text) or one slice of the
hashes, in which a window counts once for each block of a batch. Windows are
told apart by 128 bits: a hash of all words and 8 bits of each word of the
anchor. With more blocks than documents in a batch, a passage that very many
documents share takes 37 bytes for each of them in one slice.

Null texts have no words. Rows that repeat an id count as one document: what
starts at the same word of it is not earlier. Null ids are one document after
all others, in one block. Kept words are joined by one space. Texts of any
length are taken whole. An empty table gives none; columns beyond doc_id and
text aren't read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import Filter, Run, discard, materialize, mix, ngram_hashes, runs

WINDOW, PHRASE = 20, 8
BLOCK_CHARS = 8_000_000
#: The id of documents without one.
LAST = (1 << 63) - 1

_KEYS = ("hash", "phrase")
_PLACE = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("flag", "u1")])
_WINDOW = np.dtype([*_PLACE.descr, ("phrase", "<u8")])


def _anchors(run: Run, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of a run, the place of each one's anchor, hashes of all phrases."""
    width = window - phrase + 1
    text = np.repeat(np.arange(len(run.ends)), np.diff(run.ends, prepend=0))
    if len(text) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
    h = ngram_hashes(run.hashes, phrase)
    least, place = h[: len(h) - width + 1].copy(), np.zeros(len(h) - width + 1, np.int64)
    for k in range(1, width):
        other = h[k : k + len(least)]
        less = other < least
        least[less], place[less] = other[less], k
    return starts, starts + place[starts], h


def _block(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch["doc_id"].cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _recurring_anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, run in runs(batch["text"], lower=False):
                _, places, h = _anchors(run, window, phrase)
                found.append(h[np.unique(places)])
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(np.minimum(n, 2), pa.int64())], ["anchor", "n"])

    return docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _phrases(hashes: np.ndarray, phrase: int) -> np.ndarray:
    """The phrase that starts at each word, by 8 bits of each of its words."""
    code = np.zeros(max(0, len(hashes) - phrase + 1), np.uint64)
    for j in range(phrase):
        code = (code << np.uint64(8)) | (hashes[j : j + len(code)] >> np.uint64(56))
    return code


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _confirmed(docs: DataFrame, window: int, phrase: int, blocks: int) -> DataFrame:
    """(block, places): the recurring windows of each block, where the block has them first; the flag marks the very first start."""
    anchors = materialize(_recurring_anchors(docs, window, phrase), "anchors")
    shared = docs.sparkSession.sparkContext.broadcast(Filter.of(anchors, "anchor"))
    discard(anchors)
    parts = blocks

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = _ids(batch), []
            for at, run in runs(batch["text"], lower=False):
                starts, places, h = _anchors(run, window, phrase)
                keep = shared.value.may_hold(h[places])
                starts = starts[keep]
                text = np.searchsorted(run.ends, starts, side="right")
                rows = np.zeros(len(starts), _WINDOW)
                rows["hash"] = ngram_hashes(run.hashes, window)[starts] if len(starts) else 0
                rows["phrase"] = _phrases(run.hashes, phrase)[places[keep]]
                rows["doc"] = ids[at + text]
                rows["at"] = starts - np.concatenate([[0], run.ends[:-1]])[text]
                found.append(rows)
            rows = np.concatenate(found) if found else np.zeros(0, _WINDOW)
            if not len(rows):
                continue
            block = _block(rows["doc"], blocks)
            order = np.lexsort((rows["at"], rows["doc"], block, rows["phrase"], rows["hash"]))
            rows, block = rows[order], block[order]
            heads = np.flatnonzero(_changes(*[rows[k] for k in _KEYS], block))
            last = np.append(heads[1:], len(rows)) - 1
            first = rows[heads]
            first["flag"] = (rows["doc"][last] != first["doc"]) | (rows["at"][last] != first["at"])  # again in this block
            part = (first["hash"] >> np.uint64(40)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            first, part = first[order], part[order]
            cuts = np.flatnonzero(_changes(part))
            yield pa.record_batch([pa.array(part[cuts], pa.int32()), pa.array([x.tobytes() for x in np.split(first, cuts[1:])], pa.binary())], ["part", "places"])

    def resolve(t: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _WINDOW) for x in t["places"]])
        rows = rows[np.lexsort((rows["at"], rows["doc"], rows["phrase"], rows["hash"]))]
        new = _changes(*[rows[k] for k in _KEYS])
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        last = np.append(heads[1:], len(rows)) - 1
        again = np.maximum.reduceat(rows["flag"], heads).astype(bool)
        recurs = again | (rows["doc"][last] != rows["doc"][heads]) | (rows["at"][last] != rows["at"][heads])
        rows["flag"] = new  # the very first start
        rows = rows[recurs[group]]
        block = _block(rows["doc"], blocks)
        order = np.lexsort((rows["at"], rows["doc"], rows["phrase"], rows["hash"], block))
        rows, block = rows[order], block[order]
        keep = _changes(*[rows[k] for k in _KEYS], block)
        rows, block = rows[keep], block[keep]
        cuts = np.flatnonzero(_changes(block))
        each = np.split(rows, cuts[1:]) if len(rows) else []
        places = [x[list(_PLACE.names)].astype(_PLACE).tobytes() for x in each]
        return pa.table({"block": pa.array(block[cuts], pa.int32()), "places": pa.array(places, pa.binary()), "phrases": pa.array([np.unique(x["phrase"]).tobytes() for x in each], pa.binary())})

    packed = docs.select("doc_id", "text").mapInArrow(windows, "part int, places binary")
    return packed.groupBy("part").applyInArrow(resolve, "block int, places binary, phrases binary")


def _letters(words: np.ndarray) -> str:
    """Words (8 bits each) as two letters, of alphabets of their own: a node of an automaton has at most 16 children, and hits end at words."""
    return np.stack([words >> np.uint8(4), (words & np.uint8(15)) + np.uint8(16)], axis=-1).tobytes().decode("latin-1")


def _automaton(phrases: np.ndarray, phrase: int):  # noqa: ANN202
    """An automaton over the letters of words; gives the end of each phrase."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    letters = _letters(phrases.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - phrase :])
    for i in range(0, len(letters), 2 * phrase):
        out.add_word(letters[i : i + 2 * phrase], 1)
    out.make_automaton()
    return out


def _covered(run: Run, ids: np.ndarray, known: np.ndarray, automaton, window: int, phrase: int) -> np.ndarray:  # noqa: ANN001
    """Of each word of a run whether it goes."""
    gone = np.zeros(len(run.hashes) + 1, np.int64)
    if automaton is None or len(run.hashes) < window:
        return gone[:-1].astype(bool)
    hits = np.fromiter((end for end, _ in automaton.iter(_letters((run.hashes >> np.uint64(56)).astype(np.uint8)))), np.int64) // 2 - (phrase - 1)
    near = np.zeros(len(run.hashes) + 1, np.int64)  # windows that may have a hit inside
    np.add.at(near, np.maximum(hits - (window - phrase), 0), 1)
    np.add.at(near, hits + 1, -1)
    text = np.repeat(np.arange(len(run.ends)), np.diff(run.ends, prepend=0))
    starts = np.flatnonzero((np.cumsum(near)[: len(text) - window + 1] > 0) & (text[: len(text) - window + 1] == text[window - 1 :]))
    if not len(starts):
        return gone[:-1].astype(bool)
    h = ngram_hashes(run.hashes, window)[starts]
    at = np.minimum(np.searchsorted(known["hash"], h), len(known) - 1)
    place = starts - np.concatenate([[0], run.ends[:-1]])[text[starts]]
    first = (known["flag"][at] == 1) & (known["doc"][at] == ids[text[starts]]) & (known["at"][at] == place)
    starts = starts[(known["hash"][at] == h) & ~first]
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    return np.cumsum(gone)[:-1] > 0


def _locate(texts: pa.Table, told: pa.Table, window: int, phrase: int) -> pa.Table:
    """One block: compile its automaton and stream its documents through."""
    batch = texts.combine_chunks()
    ids = batch["doc_id"].cast(pa.int64()).fill_null(LAST).to_numpy().astype(np.int64)
    known = np.concatenate([np.frombuffer(x.as_buffer(), _PLACE) for x in told["places"]]) if len(told) else np.zeros(0, _PLACE)
    known = known[np.argsort(known["hash"], kind="stable")]
    automaton = _automaton(np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in told["phrases"]])), phrase) if len(known) else None
    texts_out, n_words, n_removed = [], [], []
    raw = batch["text"].to_pylist()
    for at, run in runs(batch["text"], lower=False):
        gone = _covered(run, ids[at : at + len(run.ends)], known, automaton, window, phrase)
        for i in range(len(run.ends)):
            own = gone[run.of(i)]
            own_words = raw[at + i].encode().split() if raw[at + i] else []
            n_words.append(len(own))
            n_removed.append(int(own.sum()))
            texts_out.append(b" ".join(compress(own_words, ~own) if n_removed[-1] else own_words).decode())
    return pa.table({"doc_id": batch["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(texts_out, pa.string())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and ``text``, what is kept. A phrase has eight words at most."""
    assert 0 < phrase <= min(8, window)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(4, -(-chars // BLOCK_CHARS))
    told = materialize(_confirmed(docs, window, phrase, blocks), "windows")

    @F.pandas_udf("int")
    def block_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(_block(ids.to_numpy(np.int64), blocks))

    def locate(texts: pa.Table, places: pa.Table) -> pa.Table:
        return _locate(texts.select(["doc_id", "text"]), places, window, phrase)

    keyed = docs.withColumn("block", block_of(F.coalesce("doc_id", F.lit(LAST))))
    return keyed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(locate, "doc_id long, n_words long, n_removed long, text string")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


ORACLE = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS pos, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')))) AS h FROM words WHERE len(w) >= {WINDOW}),
again AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM again),
lists AS (SELECT doc_id, list(pos) AS l FROM gone GROUP BY doc_id),
kept AS (SELECT words.doc_id, len(w) AS n, coalesce(len(l), 0) AS r, CASE WHEN l IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(l, i)) END AS k FROM words LEFT JOIN lists USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
