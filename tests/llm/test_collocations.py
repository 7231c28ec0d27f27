"""Phrase mining against plain counting, with hot prefixes, small batches and odd texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewave.llm import collocations

SHAPE = "doc_id long, text string, lang string, n int, word string, g string, `a.b` int"


def plain(rows, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    gone = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * f[lang, p[i : i + k]]:
                    gone.add((lang, p[i : i + k]))
    out = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rank, found = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [*"abcde", "é", "straße", "X", "i.e", "#", " z", "😀"]
    weights = [30, 20, 10, 8, 8, 6, 6, 5, 3, 3, 3, 2]
    out = [(None, "en"), ("", None), (" \t ", "en"), ("...", None), ("a", "only"), ("A a A a! a\x0ba\x0ca\ra", "en")]
    for _ in range(600):
        text = "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ":"]) for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "en", "de", "", None, "und"])))
    out += [("new york city hall", "en")] * 45 + [("big york city hall", "en")] * 9
    out.append(("a b " * 30_000, "de"))
    return out


@pytest.mark.parametrize("pointers,batch,run", [(200_000, 1 << 20, 1 << 19), (2, 50, 100)])
def test_against_counting(spark, rows, monkeypatch, pointers, batch, run):
    monkeypatch.setattr(collocations, "MOST_POINTERS", pointers)
    monkeypatch.setattr(collocations, "BATCH_WORDS", batch)
    monkeypatch.setattr(collocations, "RUN_BYTES", run)
    docs = spark.createDataFrame([(i, t, k, 1, "w", "g", 2) for i, (t, k) in enumerate(rows)], SHAPE).repartition(3)
    for top in (2000, 7):
        assert sorted(map(tuple, collocations.mine(docs, top).collect())) == sorted(plain(rows, top))


def test_empty(spark):
    found = collocations.mine(spark.createDataFrame([], SHAPE))
    assert found.count() == 0 and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_growth_is_depth_first():
    codes = np.array([[1, 2, 0, 0], [1, 2, 3, 0], [1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 6, 7]])
    n = np.array([5, 10, 40, 29, 31])
    assert list(collocations.grow(codes, n, 2)) == [(0, 2, 115), (1, 3, 79), (2, 4, 40), (4, 3, 31), (4, 4, 31)]
    assert list(collocations.grow(codes[:1], n[:1], 2)) == []
    assert list(collocations.grow(codes[:1], n[:1], 2, whole=False)) == [(0, 2, 5)]


def test_exact_scores(spark):
    """Products beyond 64 bits are exact."""
    big = 4_000_000_000_000_000_000
    phrases = spark.createDataFrame([(1, 5, 6, 0, 0, big)], "g long, c1 long, c2 long, c3 long, c4 long, a long")
    frequent = spark.createDataFrame([(1, 5, "en", "x", big + 1), (1, 6, "en", "y", big + 2), (1, 0, "en", None, 9)], "g long, c1 long, lang string, word string, n long")
    assert collocations._scored(phrases, frequent).first()["score"] == 2_000_000 * big // (2 * big + 3)
