"""Operator 12: toxic spans by a linear-chain conditional random field.

Words (stretches of letters, A-Z lower-cased) are tagged as toxic or not. Labels
are known for documents only, so labels of words are derived from them first:
in a toxic document a word counts as toxic if it, or its beginning, is tied to
toxic documents beyond chance and in changing surroundings (so that copies of
one text do not make all its words suspect); all other words are clean. The
field has weights for the word, its beginnings and its end, and for the change
from one tag to the next. It is trained on windows of words by the gradient of
the likelihood, with forward and backward sums.

Scoring runs forward and backward over every word of every whole text, which
gives each word's marginal probability. The greatest of them and the expected
number of toxic words make the score of the document, by a logistic curve fitted
to the labels. Words of at least even odds are the offending spans.

The fit uses a bounded sample (``TRAIN_ROWS`` labelled rows, ``WINDOWS`` windows of
each); everything is scored. Texts without words (null, empty, only signs) are
scored like others, as texts without toxic words. Without labelled rows of both
classes the score is the share of toxic rows, or 0.5. Repeated label rows count
as one with the greatest label, and of repeated rows of a document the text with
the smallest hash is learned from; each row is scored. Very long texts are taken
whole. An empty table gives none; columns beyond doc_id, text and toxic aren't
read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import discard, materialize, mix

HELD_OUT_OF, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Bounds of the training sample: labelled rows, and windows of a row for each kind of centre.
TRAIN_ROWS, WINDOWS = 12_000, 2
#: Words on each side of a window's centre.
REACH = 4
BUCKETS = 1 << 20
#: Bytes of a word's beginning that are features of their own.
HEADS = (3, 4, 5, 6)
FEATURES = 2 + len(HEADS)
#: Features that may prove a word toxic: the word and its longer beginnings.
PROOFS = (0, 2, 3, 4)
#: A proof is this much more frequent in toxic documents, and has this likelihood ratio statistic and so many surroundings.
LEAST_ODDS, LEAST_RATIO, LEAST_SURROUNDINGS = 7.0, 2 * np.log(BUCKETS), 5
EPOCHS, RATE, RIDGE = 60, 0.15, 1e-4
#: Share of words whose features are left out in a step, so that changes of tags are learned for unknown words.
UNKNOWN = 0.2
#: Texts are cut into words in pieces of about so many bytes.
PIECE_BYTES = 1 << 19
#: Words of a block within which forward and backward steps run side by side with other blocks.
BLOCK = 32

_LOWER = np.zeros(256, np.uint8)
_LOWER[97:123] = _LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT


def _features(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Buckets of each word's features: the word (by its first and last 8 bytes and length), beginnings, end."""
    size = np.minimum(stops - starts, 8)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(8, np.uint8), low, np.zeros(8, np.uint8)]), 8)
    head = np.ascontiguousarray(eight[starts + 8]).view("<u8")[:, 0] & _FIRST[size]
    tail = np.ascontiguousarray(eight[stops]).view("<u8")[:, 0] >> (8 * (8 - size)).astype(np.uint64)
    end = tail >> (8 * np.maximum(size - 3, 0)).astype(np.uint64)
    out = np.empty((len(starts), FEATURES), np.int32)
    keys = [mix(head + _ODD) ^ tail + (stops - starts).astype(np.uint64) * _ODD, *(head & _FIRST[k] for k in HEADS), end]
    for j, key in enumerate(keys):
        out[:, j] = mix(key * _ODD + np.uint64(j + 1)) & np.uint64(BUCKETS - 1)
    return out


def _cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and where words start and stop; texts end at ``offsets``."""
    low = _LOWER[raw]
    solid = low > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    stops = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    return low, starts, stops


@dataclass
class Words:
    """Words of some consecutive texts: features, byte positions within their text, and the text of each."""

    features: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    text: np.ndarray


def words(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Cut a column of texts (null: empty) into groups; gives the first text, how many, and their words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        parts, first, last = [], offsets[at], offsets[to]
        while first < last or not parts:
            stop = min(last, first + PIECE_BYTES)
            while stop < last and _LOWER[data[stop]]:  # a long text is cut between words
                stop += 1
            ends = offsets[at : to + 1]
            low, starts, stops = _cut(data[first:stop], ends[(ends >= first) & (ends <= stop)] - first)
            parts.append((_features(low, starts, stops), starts + first, stops + first))
            first = max(stop, first + 1)
        features, starts, stops = (np.concatenate(x) for x in zip(*parts))
        text = np.searchsorted(offsets[at : to + 1], starts, side="right") - 1
        yield at, to - at, Words(features, starts - offsets[at + text], stops - offsets[at + text], text)
        at = to


@dataclass
class Model:
    """Weights of features for the toxic tag, of changes of tags (from, to) and of first tags; the score's curve."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    #: Constant, slopes of the two measures, their centres and scales.
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0, 0, 0, 0, 1, 1]))

    def marginals(self, w: Words) -> np.ndarray:
        """Probability of the toxic tag of each word."""
        return chain_marginals(self.weights[w.features].sum(1, dtype=np.float64), w.text, self.change, self.first)

    def score(self, measures: np.ndarray) -> np.ndarray:
        c = self.curve
        return 1 / (1 + np.exp(-np.clip(c[0] + ((measures - c[3:5]) / c[5:7]) @ c[1:3], -30, 30)))


def chain_marginals(z: np.ndarray, text: np.ndarray, change: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marginals of the toxic tag; ``z`` is what each word adds to it, ``text`` tells chains apart.

    Steps are two-by-two matrices. They are multiplied within blocks, all blocks
    side by side; one pass over the blocks gives the sums at their borders, from
    which the words within follow. The first word of a text doesn't look back, so
    all texts make one chain.
    """
    n = len(z)
    if not n:
        return np.zeros(0)
    blocks = -(-n // BLOCK)
    step = np.zeros((2, 2, blocks * BLOCK))
    begins = np.ones(n, bool)
    begins[1:] = text[1:] != text[:-1]
    toxic = np.exp(np.clip(z, -30, 30))
    for i in range(2):
        for j in range(2):
            step[i, j, :n] = np.where(begins, np.exp(first[j]), np.exp(change[i, j])) * (toxic if j else 1)
            step[i, j, n:] = i == j
    step /= step.max((0, 1))
    step = step.reshape(2, 2, blocks, BLOCK)
    whole = step[..., 0].copy()
    for t in range(1, BLOCK):
        whole = np.einsum("ijb,jkb->ikb", whole, step[..., t])
        whole /= whole.max((0, 1))
    ahead, back = np.empty((blocks, 2)), np.empty((blocks, 2))
    rows = whole.transpose(2, 0, 1).reshape(blocks, 4).tolist()
    x, y = 1.0, 0.0
    for b, (p, q, r, s) in enumerate(rows):
        ahead[b] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    x = y = 0.5
    for b in range(blocks - 1, -1, -1):
        back[b] = x, y
        p, q, r, s = rows[b]
        x, y = p * x + q * y, r * x + s * y
        x, y = x / (x + y), y / (x + y)
    forward = np.empty((BLOCK, 2, blocks))
    v = ahead.T
    for t in range(BLOCK):
        v = np.stack([v[0] * step[0, 0, :, t] + v[1] * step[1, 0, :, t], v[0] * step[0, 1, :, t] + v[1] * step[1, 1, :, t]])
        v /= v.sum(0)
        forward[t] = v
    out = np.empty((blocks, BLOCK))
    v = back.T
    for t in range(BLOCK - 1, -1, -1):
        both = forward[t] * v
        out[:, t] = both[1] / both.sum(0)
        v = np.stack([step[0, 0, :, t] * v[0] + step[0, 1, :, t] * v[1], step[1, 0, :, t] * v[0] + step[1, 1, :, t] * v[1]])
        v /= v.sum(0)
    return out.ravel()[:n]


def measures(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each text the log odds of its most suspect word, and the log of the expected number of toxic words."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    top, total = np.full(n, 1e-9), np.zeros(n)
    np.maximum.at(top, text, p)
    np.add.at(total, text, p)
    return np.stack([np.log(top / (1 - top)), np.log(total + 1e-6)], 1)


# ---- learning --------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """(doc_id, text, toxic): about ``rows`` labelled documents at most that are not held out, drawn by hash."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    known = known.groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    rate = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < rate * (1 << 20))
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by ``rows``
    return joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _suspects(sample: DataFrame, toxic: int, clean: int) -> pd.DataFrame:
    """(bucket, proof): features that are more frequent in toxic documents, and whether they prove a word toxic.

    At most ``BUCKETS`` rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros((2, BUCKETS), np.int64), np.zeros(BUCKETS, np.uint64)
        for batch in batches:
            label = batch["toxic"].to_numpy()
            for at, size, w in words(batch["text"]):
                y = label[at : at + size]
                one = np.unique(w.text[:, None] * BUCKETS + w.features)
                for c in (0, 1):
                    n[c] += np.bincount(one[y[one // BUCKETS] == c] % BUCKETS, minlength=BUCKETS)
                word = np.concatenate([[0], w.features[:, 0], [0]]).astype(np.uint64)
                around = np.uint64(1) << (mix(word[:-2] * _ODD + word[2:]) & np.uint64(63))
                own = y[w.text] == 1
                for j in range(FEATURES):
                    np.bitwise_or.at(seen, w.features[own, j], around[own])
        at = np.flatnonzero(n[1])
        yield pa.record_batch([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at]), pa.array(seen[at].view(np.int64))], ["bucket", "clean", "toxic", "seen"])
        at = np.flatnonzero((n[1] == 0) & (n[0] > 0))
        yield pa.record_batch([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at]), pa.array(seen[at].view(np.int64))], ["bucket", "clean", "toxic", "seen"])

    counted = sample.select("text", "toxic").mapInArrow(count, "bucket long, clean long, toxic long, seen long")
    counted = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("seen")).alias("seen"))
    odds = ((F.col("toxic") + 0.5) / (toxic + 1.0)) / ((F.col("clean") + 0.5) / (clean + 1.0))
    found = counted.withColumn("odds", odds).where("toxic > 1 and odds > 2").toPandas()
    # surroundings estimated from the share of bits that are set
    around = np.where(found["seen"] < 64, -64 * np.log1p(-np.minimum(found["seen"], 63) / 64), np.inf)
    a = np.minimum(found["toxic"], around)
    b, share = found["clean"].to_numpy(float), toxic / (toxic + clean)
    term = lambda n, e: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / e), 0)
    ratio = 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share)))
    return pd.DataFrame({"bucket": found["bucket"], "proof": (found["odds"] >= LEAST_ODDS) & (ratio >= LEAST_RATIO) & (around >= LEAST_SURROUNDINGS)})


def _windows(sample: DataFrame, suspects: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (windows x words x features), tags, and which words there are, of the training windows."""
    kind = np.zeros(BUCKETS, np.uint8)
    kind[suspects["bucket"]] = 1 + suspects["proof"].to_numpy(np.uint8)
    shared = sample.sparkSession.sparkContext.broadcast(kind)
    span = 2 * REACH + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch["toxic"].to_numpy()
            for at, size, w in words(batch["text"]):
                if not len(w.text):
                    continue
                known = shared.value[w.features]
                proof = (known[:, PROOFS] == 2).any(1)
                tag = proof & (label[at : at + size][w.text] == 1)
                group = np.where(tag, 0, np.where((known > 0).any(1), 1, 2))
                # of each text and group the centres with the smallest hashes
                order = np.lexsort((mix(np.arange(len(tag), dtype=np.uint64) * _ODD + w.features[:, 0].astype(np.uint64)), group, w.text))
                key = w.text[order] * 3 + group[order]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                nth = np.arange(len(key)) - np.repeat(start, np.diff(np.concatenate([start, [len(key)]])))
                centre = order[nth < WINDOWS]
                place = centre[:, None] + np.arange(-REACH, REACH + 1)
                inside = (place >= 0) & (place < len(tag))
                place = np.clip(place, 0, len(tag) - 1)
                inside &= w.text[place] == w.text[centre][:, None]
                x, y = w.features[place], tag[place] & inside
                rows = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, y, inside)]
                yield pa.record_batch(rows, ["x", "y", "inside"])

    found = sample.select("text", "toxic").mapInArrow(cut, "x binary, y binary, inside binary").toPandas()  # at most 3 x WINDOWS x TRAIN_ROWS rows
    found = found.sort_values(["x", "y", "inside"])
    read = lambda c, kind: np.frombuffer(b"".join(found[c]), kind)
    return read("x", np.int32).reshape(-1, span, FEATURES), read("y", bool).reshape(-1, span), read("inside", bool).reshape(-1, span)


def train(x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> Model:
    """Weights by Adam's steps (Kingma and Ba 2015) up the log likelihood of the windows' tags."""
    model = Model(weights=np.zeros(BUCKETS, np.float64))
    if not len(x):
        return Model()
    n, span = y.shape
    # a window is a chain of its own: what lies outside its text is passed over
    text = np.repeat(np.arange(n), span).reshape(n, span)[inside]
    feats, tags = x[inside], y[inside].astype(float)
    begins = np.ones(len(text), bool)
    begins[1:] = text[1:] != text[:-1]
    pair = np.flatnonzero(~begins)
    t = tags.astype(int)
    seen_change, seen_first = np.zeros((2, 2)), np.bincount(t[begins], minlength=2).astype(float)
    np.add.at(seen_change, (t[pair - 1], t[pair]), 1)
    moments = [(value, np.zeros_like(value), np.zeros_like(value)) for value in (model.weights, model.change, model.first)]
    flat, rng = feats.ravel(), np.random.default_rng(0)
    for step in range(1, EPOCHS + 1):
        known = (rng.random(len(tags)) >= UNKNOWN).astype(float)
        z = model.weights[feats].sum(1) * known
        p, both = _expected(z, begins, model.change, model.first)
        slope = np.bincount(flat, np.repeat((tags - p) * known, FEATURES), BUCKETS) - RIDGE * len(tags) / BUCKETS * model.weights
        slope_change = seen_change - both
        slope_first = seen_first - np.array([(1 - p[begins]).sum(), p[begins].sum()])
        for g, (value, mean, square) in zip((slope, slope_change, slope_first), moments):
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            value += RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    model.weights = model.weights.astype(np.float32)
    return model


def _expected(z: np.ndarray, begins: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, and the expected number of each change of tags, over short chains side by side."""
    start = np.flatnonzero(begins)
    size = np.diff(np.concatenate([start, [len(z)]]))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    longest = int(size[0])
    live = [int((size > t).sum()) for t in range(longest)]  # chains that have a word t, the longest first
    a = np.exp(change)
    e = np.exp(np.clip(z, -30, 30))
    f, b = np.empty((len(z), 2)), np.empty((len(z), 2))
    for t in range(longest):
        i = start[: live[t]] + t
        v = np.exp(first)[None] * np.ones((len(i), 1)) if not t else f[i - 1] @ a
        v = v * np.stack([np.ones(len(i)), e[i]], 1)
        f[i] = v / v.sum(1, keepdims=True)
    b[start + size - 1] = 0.5
    for t in range(longest - 2, -1, -1):
        i = start[: live[t + 1]] + t
        v = (b[i + 1] * np.stack([np.ones(len(i)), e[i + 1]], 1)) @ a.T
        b[i] = v / v.sum(1, keepdims=True)
    both = f * b
    p = both[:, 1] / both.sum(1)
    i = np.flatnonzero(~begins)
    joint = f[i - 1][:, :, None] * a[None] * (b[i] * np.stack([np.ones(len(i)), e[i]], 1))[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return p, joint.sum(0)


def _curve(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve over two measures by Newton's steps, with a small ridge."""
    centre, scale = m.mean(0), np.maximum(m.std(0), 1e-6)
    x = np.column_stack([np.ones(len(m)), (m - centre) / scale])
    c = np.array([np.log(y.mean() / (1 - y.mean())), 0, 0])
    ridge = np.diag([1e-6, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ c)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([c, centre, scale])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """Learn from about ``rows`` labelled documents at most that are not held out."""
    sample = materialize(_sample(docs, labels, rows, seed), "toxicity")
    have = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = have.get(1, 0), have.get(0, 0)
    if not toxic or not clean:
        share = np.clip(toxic / (toxic + clean), 0.001, 0.999) if toxic + clean else 0.5
        return Model(curve=np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 1, 1]))
    model = train(*_windows(sample, _suspects(sample, toxic, clean)))
    found = _measured(sample, model, "toxic").toPandas().sort_values(["toxic", "top", "total"])  # bounded by ``rows``
    model.curve = _curve(found[["top", "total"]].to_numpy(float), found["toxic"].to_numpy(float))
    discard(sample)
    return model


# ---- scoring ---------------------------------------------------------------------------


def _spans(text: str, w: Words, bad: np.ndarray) -> list[tuple[int, int]]:
    """Code point positions of stretches of neighbouring bad words; ``bad`` holds indices in order."""
    raw = np.frombuffer(text.encode(), np.uint8)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = np.flatnonzero(np.diff(bad) != 1)
    return list(zip(points[w.starts[bad[np.concatenate([[0], ends + 1])]]].tolist(), points[w.stops[bad[np.concatenate([ends, [len(bad) - 1]])]]].tolist()))


def _measured(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The given columns of ``docs``, both measures and the spans of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            out, spans = np.zeros((len(texts), 2)), [[] for _ in range(len(texts))]
            for at, size, w in words(texts):
                p = shared.value.marginals(w)
                out[at : at + size] = measures(p, w.text, size)
                bad = np.flatnonzero(p >= THRESHOLD)
                for own in np.split(bad, np.flatnonzero(np.diff(w.text[bad])) + 1) if len(bad) else []:
                    i = at + int(w.text[own[0]])
                    spans[i] = [{"start": a, "end": b} for a, b in _spans(texts[i].as_py(), w, own)]
            found = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(out[:, 0]), pa.array(out[:, 1]), found], names=[*columns, "top", "total", "spans"])

    return docs.select(*columns, "text").mapInArrow(run, f"{kinds}, top double, total double, spans array<struct<start: int, end: int>>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending spans (code points, end exclusive) of every whole text."""
    c = [float(x) for x in model.curve]
    logit = F.lit(c[0]) + F.lit(c[1]) * (F.col("top") - c[3]) / c[5] + F.lit(c[2]) * (F.col("total") - c[4]) / c[6]
    out = _measured(docs, model, "doc_id").withColumn("score", F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)))), 9))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
