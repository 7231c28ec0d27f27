"""Operator 7: text quality by a generalised additive model with pair terms.

Each whole text is turned into a few numeric features. A bounded sample of
labelled rows trains the model on the driver: features are cut into quantile
bins, shallow trees are boosted on one feature at a time in turn, then on the
strongest feature pairs; what they learn is kept as one lookup table per
feature and per pair. Scoring adds up table entries by bin, in numpy batches.

Null and empty texts have features of zero and are scored like others; very long
ones are taken whole. Without labelled rows of both classes the score is the
share of good rows, or 0.5. Repeated label rows count as one with the greatest
quality, and of repeated rows of a document the text with the smallest hash is
learned from. An empty table gives none; columns beyond doc_id, text and
quality aren't read and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_OF, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Bound of the training sample, chosen by hash of the id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_ROWS, RIDGE = 120, 40, 0.1, 3, 5, 1.0
FEATURES = ("log_chars", "word_chars", "upper", "symbols", "digits", "distinct_words", "log_line_chars", "repeated_lines", "exclaims", "odd_marks", "short_words", "beyond_ascii", "top_word", "same_ends")

_CLASS = np.zeros((256, 6))
for _c in range(256):
    _CLASS[_c] = (65 <= _c <= 90, 97 <= _c <= 122, 48 <= _c <= 57, 33 <= _c <= 126 and not chr(_c).isalnum(), _c == 33, chr(_c) in "#$%&*|@^~<>{}[]=+\\_")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT


def features(text: str | None) -> np.ndarray:
    """The features of one whole text, in the order of ``FEATURES``."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, symbols, exclaims, odd = counts @ _CLASS
    size = len(text)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    seen = Counter(words)
    out[0] = np.log1p(size)
    out[1] = sum(map(len, words)) / n
    out[2] = upper / max(1, upper + lower)
    out[3] = symbols / size
    out[4] = digits / size
    out[5] = len(seen) / n
    out[6] = np.log1p(size / len(lines))
    out[7] = 1 - len(set(lines)) / len(lines)
    out[8] = exclaims / n
    out[9] = odd / n
    out[10] = sum(len(w) <= 3 for w in words) / n
    out[11] = counts[128:].sum() / len(raw)
    out[12] = max(seen.values(), default=0) / n
    out[13] = max(Counter(w[-1] for w in words).values(), default=0) / n
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Sum of the entries that each row's bins select."""
        out = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(values: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, n) / n))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Step values per bin of a tree on ordered bins, grown by best gain."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = gain_of(a, k) + gain_of(k, b) - gain_of(a, b)
                gain[(cn[k] - cn[a] < LEAST_ROWS) | (cn[b] - cn[k] < LEAST_ROWS)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], p, int(k[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step values of the best cut of a grid into four quadrants."""
    pad = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = pad(g), pad(h)
    best, out = 0.0, np.zeros_like(g)
    m, n = g.shape
    for i in range(1, m):
        for j in range(1, n):
            gain, step = 0.0, np.zeros_like(g)
            for r, s in (((0, i), (0, j)), ((0, i), (j, n)), ((i, m), (0, j)), ((i, m), (j, n))):
                total = lambda c: c[r[1], s[1]] - c[r[0], s[1]] - c[r[1], s[0]] + c[r[0], s[0]]  # noqa: B023, E731
                gain += total(cg) ** 2 / (total(ch) + RIDGE)
                step[r[0] : r[1], s[0] : s[1]] = total(cg) / (total(ch) + RIDGE)
            if gain > best:
                best, out = gain, step
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of one-feature trees, then of the strongest pairs."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return Model(float(np.log(share / (1 - share))))
    share = float(y.mean())
    model = Model(float(np.log(share / (1 - share))))
    k = x.shape[1]
    model.edges = [_cuts(x[:, j], BINS) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    logit = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), np.bincount(bins[j], minlength=size), LEAVES)
            model.tables[j] += step
            logit += step[bins[j]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(k) for b in range(a)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1))) for _, a, b in gains]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            logit += step[coarse[a], coarse[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """Learn from labelled rows that are not held out; about ``rows`` of them at most, drawn by hash."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(False))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rate = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < rate * (1 << 20))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t).tolist() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["quality"].astype(float), "x": x})

    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # the sample is bounded by ``rows``
    joined = joined.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # also where ids repeat
    found = joined.mapInPandas(run, "doc_id long, y double, x array<double>").toPandas()
    found = found.assign(key=found["x"].map(tuple)).sort_values(["doc_id", "y", "key"])
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return train(x, (found["y"].to_numpy(float) >= 1).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]]).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": shared.value.score(x)})

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
