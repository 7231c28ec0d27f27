"""Operator 3: stupid-backoff language-model scores of documents.

All n-grams (one to three words, A-Z lower-cased) of all documents are counted
in tables partitioned by hash; every block of documents gets the counts of its
own n-grams back, looks them up for the n-gram at each word, and sums per
document. S(w | u v) is count(u v w) / count(u v) if u v w was seen at least
``least`` times, else ``backoff`` times S(w | v), down to count(w) / words. The
first words of a text have shorter contexts, which costs no backoff.

A block is a range of ids (about ``BLOCK_CHARS`` of text). From each batch a
block's distinct n-grams travel as sorted arrays of hashes cut by their upper
bits; the answer is an array of counts in the same order. So frequent n-grams
are summed before the shuffle, and a task holds one block or one slice of the
hashes. If ids don't follow the order of storage, only more bytes travel.

Each logarithm is rounded to a millionth, so sums don't depend on their order.
Null texts and texts without words have 0 words, score 0 and a null mean.
Rows are independent, so repeated rows give repeated results (and count twice).
Texts of any length are taken whole. An empty table gives none; columns beyond
doc_id and text aren't read and may have any name. N-grams are known by hashes
of 56 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import Run, distinct, ngram_hashes, runs

ORDER, LEAST, BACKOFF = 3, 2, 0.4
BLOCK_CHARS = 12_000_000
MICRO = 1_000_000
#: Of the n-grams' hashes; two of a billion n-grams of one length share a hash with a chance of 1 in 72 million each.
HASH_BITS = 56


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, data): the documents of each block of a batch, compressed, for the shuffle."""
    for batch in batches:
        own = batch["block"].to_numpy()
        order = np.argsort(own, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(own) else ():
            sink = pa.BufferOutputStream()
            part = batch.select(["doc_id", "text"]).take(pa.array(rows))
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.record_batch([pa.array([own[rows[0]]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])


def _unpacked_texts(t: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in t["data"]])


def _pack(keys: np.ndarray) -> bytes:
    """Sorted distinct hashes as their differences, in five bytes each where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = 5 if not len(steps) or steps[1:].max(initial=0) < 1 << 40 else 8
    first = keys[:1].tobytes()
    return bytes([width]) + first + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.zeros(0, np.uint64)
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[1:, :width] = rest
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    """Counts in one byte each, those of 255 and more listed behind."""
    large = n[n >= 255].astype(np.uint64)
    return np.minimum(n, 255).astype(np.uint8).tobytes() + large.tobytes() + np.uint64(len(large)).tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    more = int(np.frombuffer(data, np.uint64, 1, len(data) - 8)[0])
    out = np.frombuffer(data, np.uint8, len(data) - 8 - 8 * more).astype(np.int64)
    if more:
        out[out == 255] = np.frombuffer(data, np.uint64, more, len(data) - 8 - 8 * more).astype(np.int64)
    return out


def _ngrams(run: Run, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash (``HASH_BITS``) of the n-gram that starts at each word, and whether it lies in one text."""
    h, whole = (run.hashes, np.ones(len(run.hashes), bool)) if n == 1 else run.ngrams(n)
    return h >> np.uint64(64 - HASH_BITS), whole


def _totals(t: pa.Table) -> pa.Table:
    """Of one slice of the hashes: each block's n-grams with their counts over all blocks."""
    blocks = t["block"].to_numpy()
    keys = [_unpack(x.as_py()) for x in t["keys"]]
    counts = [_unpack_counts(x.as_py()) for x in t["counts"]]
    everything = np.concatenate(keys)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums = np.add.reduceat(np.concatenate(counts)[order], heads)
    ordered = ordered[heads]
    out = []
    for b in np.unique(blocks):
        own = distinct(np.concatenate([keys[i] for i in np.flatnonzero(blocks == b)]))
        out.append((int(b), _pack_counts(sums[np.searchsorted(ordered, own)])))
    return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "n": t["n"][: len(out)], "part": t["part"][: len(out)], "counts": pa.array([c for _, c in out], pa.binary())})


def _scores(texts: pa.Table, told: pa.Table, total: int, order: int, least: int, backoff: float) -> pa.Table:
    """One block: scores of its documents from the counts of its n-grams."""
    batch = texts.combine_chunks()
    parts = list(runs(batch["text"], lower=True))
    count_of = {}
    for n in range(1, order + 1):
        keys = distinct(np.concatenate([h[ok] for h, ok in (_ngrams(run, n) for _, run in parts)] or [np.zeros(0, np.uint64)]))
        rows = sorted((p, c.as_py()) for m, p, c in zip(told["n"].to_pylist(), told["part"].to_pylist(), told["counts"]) if m == n)
        count_of[n] = keys, np.concatenate([_unpack_counts(c) for _, c in rows] or [np.zeros(0, np.int64)])
        assert len(keys) == len(count_of[n][1]), "a block must get the counts of all its n-grams"
    words, sums, offs = [], [], []
    for _, run in parts:
        size = len(run.hashes)
        place = np.arange(size) - np.repeat(np.concatenate([[0], run.ends[:-1]]), np.diff(run.ends, prepend=0))
        ending = {}  # counts of the n-gram that ends at each word
        for n in range(1, order + 1):
            h = _ngrams(run, n)[0]
            keys, counts = count_of[n]
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            ending[n] = np.zeros(size, np.int64)
            if len(keys) and len(h):
                ending[n][n - 1 :] = counts[at]
            ending[n][place < n - 1] = 0  # begins in another text
        value, off = ending[1] / max(1, total), np.zeros(size, bool)
        for n in range(2, order + 1):
            context = np.concatenate([[1], ending[n - 1][:-1]])[:size]
            seen = ending[n] >= least
            off = np.where(place >= n - 1, ~seen, off)
            value = np.where(seen, ending[n] / np.maximum(context, 1), np.where(place >= n - 1, backoff * value, value))
        micro = np.rint(np.log(value) * MICRO).astype(np.int64) if size else np.zeros(0, np.int64)
        run_sums = np.concatenate([[0], np.cumsum(micro)])
        ends = np.concatenate([[0], run.ends])
        words.append(np.diff(ends))
        sums.append(run_sums[ends[1:]] - run_sums[ends[:-1]])
        run_offs = np.concatenate([[0], np.cumsum(off)])
        offs.append(run_offs[ends[1:]] - run_offs[ends[:-1]])
    n_words = np.concatenate(words) if words else np.zeros(0, np.int64)
    log_score = (np.concatenate(sums) if sums else np.zeros(0, np.int64)) / MICRO
    backoff = np.concatenate(offs) if offs else np.zeros(0, np.int64)
    per_word = lambda x: pa.array(np.divide(x, n_words, out=np.zeros(len(x)), where=n_words > 0), mask=n_words == 0).cast(pa.float64())
    return pa.table({"doc_id": batch["doc_id"], "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(log_score, pa.float64()), "mean_log_score": per_word(log_score), "backoff_share": per_word(backoff)})


def score(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """Per document: doc_id, n_words, log_score, mean_log_score, and ``backoff_share``: of the words, those not seen often enough after their whole context."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = chars = rows = 0
        for batch in batches:
            for _, run in runs(batch["text"], lower=True):
                n, chars, rows = n + len(run.hashes), chars + len(run.data), rows + len(run.ends)
        yield pa.record_batch([pa.array([n]), pa.array([chars]), pa.array([rows])], ["words", "chars", "rows"])

    size = docs.select("text").mapInArrow(measure, "words long, chars long, rows long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "chars", "rows")]).first()
    blocks = max(4, -(-size["chars"] // BLOCK_CHARS))
    bits = (blocks - 1).bit_length()
    span = max(1, size["rows"] // blocks)
    # without an id a text goes by its hash
    block = F.pmod(F.coalesce(F.floor(F.col("doc_id") / span).cast("long"), F.xxhash64("text")), F.lit(blocks)).cast("long")
    keyed = docs.withColumn("block", block)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["block"].to_numpy()
            by_block = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[by_block], prepend=-1))
            for rows in np.split(by_block, cuts[1:]) if len(own) else ():
                found = {n: [] for n in range(1, order + 1)}
                for _, run in runs(batch["text"].take(pa.array(rows)), lower=True):
                    for n, lists in found.items():
                        h, ok = _ngrams(run, n)
                        lists.append(h[ok])
                for n, lists in found.items():
                    keys, counts = np.unique(np.concatenate(lists), return_counts=True)
                    if not len(keys):
                        continue
                    part = (keys >> np.uint64(HASH_BITS - bits)).astype(np.int64)
                    at = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(at[1:], len(keys))
                    yield pa.record_batch([
                        pa.array(np.full(len(at), own[rows[0]], np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(part[at], pa.int32()),
                        pa.array([_pack(keys[a:b]) for a, b in zip(at, ends)], pa.binary()), pa.array([_pack_counts(counts[a:b]) for a, b in zip(at, ends)], pa.binary()),
                    ], ["block", "n", "part", "keys", "counts"])

    asked = keyed.select("block", "text").mapInArrow(requests, "block long, n int, part int, keys binary, counts binary")
    told = asked.groupBy("n", "part").applyInArrow(_totals, "block long, n int, part int, counts binary")
    total = size["words"]

    def scores(texts: pa.Table, counts: pa.Table) -> pa.Table:
        return _scores(_unpacked_texts(texts), counts, total, order, least, backoff)

    packed = keyed.mapInArrow(_packed_texts, "block long, data binary")
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scores, "doc_id long, n_words long, log_score double, mean_log_score double, backoff_share double")


ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS c, w FROM texts),
grams AS (SELECT r, i, c, CASE WHEN i > 1 THEN w[i - 1] || ' ' || c END AS bc, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || c END AS abc, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS ab FROM places),
c1 AS (SELECT c AS k, count(*) AS n FROM grams GROUP BY ALL), c2 AS (SELECT bc AS k, count(*) AS n FROM grams WHERE bc IS NOT NULL GROUP BY ALL), c3 AS (SELECT abc AS k, count(*) AS n FROM grams WHERE abc IS NOT NULL GROUP BY ALL),
found AS (SELECT r, i, x.n / (SELECT count(*) FROM grams) AS s1, y.n AS n2, z.n AS n3, u.n AS u1, v.n AS u2 FROM grams g JOIN c1 x ON x.k = g.c LEFT JOIN c2 y ON y.k = g.bc LEFT JOIN c3 z ON z.k = g.abc LEFT JOIN c1 u ON u.k = g.b LEFT JOIN c2 v ON v.k = g.ab),
two AS (SELECT *, CASE WHEN i < 2 THEN s1 WHEN n2 >= {LEAST} THEN n2 / u1 ELSE {BACKOFF} * s1 END AS s2 FROM found),
three AS (SELECT *, CASE WHEN i < 3 THEN s2 WHEN n3 >= {LEAST} THEN n3 / u2 ELSE {BACKOFF} * s2 END AS s3 FROM two),
sums AS (SELECT r, sum(round(ln(s3) * {MICRO})::BIGINT)::BIGINT AS s, sum(CASE WHEN i < 2 THEN 0 WHEN i < 3 THEN (n2 < {LEAST})::INT ELSE (n3 < {LEAST})::INT END) AS b FROM three GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(s, 0) / {MICRO} AS log_score, CASE WHEN len(w) > 0 THEN coalesce(s, 0) / {MICRO} / len(w) END AS mean_log_score, CASE WHEN len(w) > 0 THEN b / len(w) END AS backoff_share FROM texts LEFT JOIN sums USING (r)
"""
