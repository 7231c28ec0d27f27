"""Periodic runs against brute force, for the Lyndon arrays, the runs and the query."""

import hashlib
import random
import zlib

import pytest

from tidewave.llm import periodic_runs, registry

SHAPE = "doc_id long, text string, runs string, `a.b` int, Start int"


def plain_lyndon(s):
    n = len(s)
    after, shared = [n] * n, [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if s[j:] < s[i:]:
                after[i] = j
                while j + shared[i] < n and s[i + shared[i]] == s[j + shared[i]]:
                    shared[i] += 1
                break
    return after, shared


def plain_runs(w, least=24, periods=3):
    """Every stretch that holds a period and can't be extended; smaller periods first claim theirs."""
    n, squares, out = len(w), [], []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i >= p:
                smaller = any(a <= i and j + p <= b and q < p and p % q == 0 for a, b, q in squares)
                squares.append((i, j + p, p))
                if not smaller and j - i + p >= max(least, periods * p):
                    out.append((i, j - i + p, p))
            i = j + 1
    return sorted(out)


def sequence(rng, most):
    n, k = rng.randint(0, most), rng.randint(1, 4)
    s = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p, m = rng.randrange(n), rng.randint(1, 12), rng.randint(0, 70)
        m = min(m, n - a)
        s = s[:a] + (s[a : a + p] * 70)[:m] + s[a + m :]
    return s


def test_lyndon_arrays():
    rng = random.Random(5)
    for _ in range(600):
        s = sequence(rng, 60)
        assert periodic_runs.lyndon(s) == plain_lyndon(s)


@pytest.mark.parametrize("least,periods", [(24, 3), (6, 3), (3, 4)])
def test_runs(least, periods):
    rng = random.Random(6)
    for _ in range(300):
        w = [b"w%d" % x for x in sequence(rng, 120)]
        assert periodic_runs.runs_of(w, least, periods) == plain_runs(w, least, periods)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("shape", [fibonacci, lambda n: [0] * n, lambda n: ([*range(7)] * n)[:n], lambda n: [i & -i for i in range(n)]])
def test_matches_are_not_repeated(shape):
    """Comparisons of words grow with the length, whatever the shape."""

    class Word(int):
        compared = 0

        def __eq__(self, other):
            Word.compared += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    for n in (2000, 8000):
        for sign in (1, -1):
            Word.compared = 0
            periodic_runs.lyndon([Word(sign * x) for x in shape(n)])
            assert Word.compared < 4 * n


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(b"".join(b"%d,%d,%d\n" % r for r in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(None, "x y " * 40), (1, None), (2, ""), (3, " \n\t"), (4, "é " * 23), (5, "é " * 24), (6, "a b c\x0bd " * 30), (7, "one two three"), (7, "one two three"), (-4, "k " * 30 + "l " * 30)]
    rows += [(i, " ".join(rng.choice("the of and a in".split()) for _ in range(rng.randint(0, 150)))) for i in range(10, 150)]
    docs = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SHAPE).repartition(3)
    monkeypatch.setattr(registry, "table", lambda *_: docs)
    found = registry.op13_periodic_runs(spark, "")
    assert sorted(map(str, (tuple(r)[:8] for r in found.collect()))) == sorted(str(expected(*r)) for r in rows)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    monkeypatch.setattr(registry, "table", lambda *_: docs.limit(0))
    assert registry.op13_periodic_runs(spark, "").count() == 0


def test_whole_texts(spark):
    """A text of very many words in one row."""
    text = "a b c d e f g h " * 40_000
    row = periodic_runs.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["start"], row["length"], row["period"], row["text"]) == (0, 320_000, 8, "a b c d e f g h")
