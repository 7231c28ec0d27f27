"""The conditional random field: sums against plain enumeration, what it learns, and odd inputs."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.llm import toxicity
from tidewave.llm.common import table

SHAPE = "doc_id long, text string, score string, top int, `a.b` int, spans int"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9):
        z, change, first = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
        weight, total = np.zeros(n), 0.0
        for tags in itertools.product((0, 1), repeat=n):
            s = np.exp(first[tags[0]] + sum(z[i] for i in range(n) if tags[i]) + sum(change[a, b] for a, b in itertools.pairwise(tags)))
            weight += s * np.array(tags)
            total += s
        assert np.allclose(toxicity.chain_marginals(z, np.zeros(n, int), change, first), weight / total)


def test_marginals_of_many_chains():
    """Blocks and borders of texts don't show; the sums used in training agree."""
    rng = np.random.default_rng(5)
    text = np.sort(rng.integers(0, 60, 1000))
    z, change, first = rng.normal(0, 3, 1000), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    p = toxicity.chain_marginals(z, text, change, first)
    for k in np.unique(text):
        assert np.allclose(p[text == k], toxicity.chain_marginals(z[text == k], text[text == k], change, first))
    begins = np.concatenate([[True], text[1:] != text[:-1]])
    q, both = toxicity._expected(z, begins, change, first)
    assert np.allclose(p, q) and np.isclose(both.sum(), (~begins).sum())


def test_gradient_raises_the_likelihood():
    rng = np.random.default_rng(6)
    x = (rng.integers(0, 50, (200, 9, toxicity.FEATURES)) + 50 * np.arange(toxicity.FEATURES)).astype(np.int32)  # each feature has buckets of its own
    y = x[:, :, 0] < 5
    model = toxicity.train(x, y, np.ones_like(y))
    z = model.weights[x].sum(2).ravel()
    p = toxicity.chain_marginals(z, np.repeat(np.arange(200), 9), model.change, model.first)
    assert ((p > 0.5) == y.ravel()).mean() > 0.98


def test_words():
    texts = pa.array(["An IDIOT, idiot!", None, "", "x" * 40 + " é1b", "..."])
    found = list(toxicity.words(texts))
    w = found[0][2]
    assert [(a, n) for a, n, _ in found] == [(0, 5)] and w.text.tolist() == [0, 0, 0, 3, 3, 3]
    assert (w.features[1] == w.features[2]).all() and (w.features[0] != w.features[1]).any()
    assert [(int(a), int(b)) for a, b in zip(w.starts, w.stops)] == [(0, 2), (3, 8), (10, 15), (0, 40), (41, 43), (44, 45)]


def test_long_texts_in_pieces(monkeypatch):
    text = "abc defgh ij é " * 500
    whole = next(toxicity.words(pa.array(["q", text])))[2]
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 100)
    parts = list(toxicity.words(pa.array(["q", text])))
    joined = [np.concatenate([getattr(p[2], f) for p in parts]) for f in ("features", "starts", "stops")]
    assert all((a == b).all() for a, b in zip(joined, (whole.features, whole.starts, whole.stops)))


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of random words; in a third of them one or more toxic words, some built on one stem."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(600)]
    bad = ["vermin", "scumbag", *(f"zorkl{e}" for e in ("a", "en", "os", "ité", "ung"))]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocabulary, rng.integers(5, 80)))
        toxic = i % 3 == 0
        for _ in range(rng.integers(1, 3) if toxic else 0):
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(bad)).upper() if rng.random() < 0.3 else str(rng.choice(bad)) + ",")
        rows.append((i, " ".join(words), "s", 1, 2, 3))
        labels.append((i, int(toxic)))
    copy = " ".join(rng.choice(vocabulary, 40))  # one toxic label on many copies makes no word toxic
    rows += [(2000 + i, copy, "s", 1, 2, 3) for i in range(40)]
    labels += [(2000 + i, 1) for i in range(40)]
    odd = [(None, "vermin"), (5000, None), (5001, ""), (5002, "... !"), (5003, "é vermin zorklos ok"), (5003, "é vermin zorklos ok"), (5004, "abc def " * 50_000 + "vermin")]
    rows += [(*r, "s", 1, 2, 3) for r in odd]
    labels += [(None, 1), (5001, None), (0, 1), (0, 0)]
    return spark.createDataFrame(rows, SHAPE).repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_planted(planted):
    docs, labels, rows = planted
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == len(rows)
    own = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 900]
    right = [r["predicted"] == (r["doc_id"] % 3 == 0) for r in own if r["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    text = {r[0]: r[1] for r in rows}
    spans = [text[r["doc_id"]][s["start"] : s["end"]].lower() for r in own if r["doc_id"] % 3 == 0 for s in r["spans"]]
    assert np.mean([any(s.startswith(b) for b in ("vermin", "scumbag", "zorkl")) for s in spans]) > 0.97 and len(spans) > 280
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["predicted"] for i in (5000, 5001, 5002, 5003, 5004, None) for r in by[i]] == [0, 0, 0, 1, 1, 1, 1]
    assert [(s["start"], s["end"]) for s in by[5003][0]["spans"]] == [(2, 16)]
    assert [(s["start"], s["end"]) for s in by[5004][0]["spans"]] == [(400_000, 400_006)]
    assert by[None][0]["held_out"] is False and all(0 <= r["score"] <= 1 for r in found)


def test_same_result_for_each_partitioning(planted):
    docs, labels, _ = planted
    one = {tuple(map(str, r)) for r in toxicity.classify(docs.coalesce(1), labels).collect()}
    assert one == {tuple(map(str, r)) for r in toxicity.classify(docs.repartition(7), labels).collect()}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    found = toxicity.classify(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    bad, good = found.score[found.toxic == 1], found.score[found.toxic == 0]
    assert (bad >= 0.5).mean() > 0.9 and (good >= 0.5).mean() < 0.02  # a part of the labels there is wrong


def test_no_labels(spark, planted):
    docs, labels, rows = planted
    assert toxicity.classify(docs, labels.limit(0)).where("score = 0.5").count() == len(rows)
    assert toxicity.classify(docs, labels.where("toxic = 0")).where("score < 0.01").count() == len(rows)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    held = toxicity.classify(docs, labels.where(toxicity.held_out(F.col("doc_id"))))
    assert held.where("score = 0.5").count() == len(rows)
