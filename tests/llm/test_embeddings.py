"""Near-duplicate embeddings against brute force."""

import numpy as np

from tidewave.llm import embedding_dedup


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    near = base[:40] + 0.05 * rng.standard_normal((40, 16))
    dense = base[100] + 0.03 * rng.standard_normal((700, 16))  # larger than any list or block
    vectors = [list(map(float, v)) for v in np.concatenate([base, near, dense, base[:5], 3 * base[5:8]])]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0], [2.0, -4.0], [1e-170] * 16, [3e-170] * 16, [5e-324] * 3, [1e-323] * 3]
    rows = [(i, v, 0, "x", 1) for i, v in enumerate(vectors)] + [(0, vectors[0], 0, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, x string, n int")
    found = embedding_dedup.near_duplicates(df).toPandas()
    sound = [(i, v) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    length = np.array([len(v) for _, v in sound])
    ids, x = np.array([i for i, _ in sound]), np.array([np.pad(np.array(v) / np.abs(v).max(), (0, 16 - len(v))) for _, v in sound])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.95) & (length[:, None] == length[None, :])  # lengths don't link with each other
    np.fill_diagonal(linked, False)
    label = ids.copy()
    for _ in range(50):
        label = np.minimum(label, np.where(linked, label[None, :], 1 << 40).min(1))
    expected = sorted([*zip(ids.tolist(), linked.sum(1).tolist(), label.tolist()), *((i, 0, i) for i, v, *_ in rows if i not in set(ids.tolist()))])
    assert sorted(zip(found.vec_id, found.n_links, found.component_id)) == expected
    assert (found.kept == (found.vec_id == found.component_id)).all()
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute(x):
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    for _ in range(50):
        label = np.minimum(label, np.where(linked, label[None, :], 1 << 40).min(1))
    return linked.sum(1), label


def test_links_between_dense_groups(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a, away = unit(rng.standard_normal((2, 64)))
    away = unit(away - (away @ a) * a)
    parts = []
    for cosine in (1.0, 0.971, 0.8):  # the second links with the first at about 0.96, the third with none
        centre = cosine * a + np.sqrt(1 - cosine**2) * away
        parts.append(unit(np.sqrt(0.99) * centre + np.sqrt(0.01) * unit(rng.standard_normal((300, 64)))))
    x = np.concatenate([*parts, unit(rng.standard_normal((100, 64)))])
    assert (parts[0] @ parts[1].T >= 0.95).mean() > 0.8
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(df).toPandas().sort_values("vec_id")
    n_links, label = brute(x)
    assert label[300] == 0 and label[600] == 600
    assert found.component_id.tolist() == label.tolist()
    assert found.n_links.tolist() == n_links.tolist()


def test_audit_sees_small_groups_beside_a_hot_one(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    hot = unit(rng.standard_normal(64)) + 0.01 * rng.standard_normal((1500, 64))
    pairs = np.repeat(rng.standard_normal((300, 64)), 2, 0) + 0.01 * rng.standard_normal((600, 64))
    x = unit(np.concatenate([hot, pairs]))
    nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, x binary")
    lists = [(i, 10, np.arange(i + 1, i + 11).tobytes(), np.full(10, 0.99, np.float32).tobytes(), bytes(10)) for i in range(1490)]
    graph = spark.createDataFrame(lists, "id long, k int, ids binary, sims binary, news binary")
    roots = spark.createDataFrame([(i, 0) for i in range(1500)], "node long, root long")  # no pair is found
    small, dense = embedding_dedup.audit(nodes, graph, roots, 5)
    assert dense == 1 and small < 0.2  # ten nodes of the hot group have no list
    alone = nodes.where("id >= 1500 and id % 2 = 0")
    assert embedding_dedup.audit(alone, graph.limit(0), roots.limit(0), 5) == (None, None)
    exact = {r["node"]: r["root"] for r in embedding_dedup._in_full(nodes, 2100).collect()}
    assert exact == {i: 0 if i < 1500 else i // 2 * 2 for i in range(2100)}
