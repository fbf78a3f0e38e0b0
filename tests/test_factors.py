"""Factors, spectral coordinates and clusters of sparse tables, against numpy on small ones."""

import numpy as np
import pytest

from stratalex.operators import factors as fa


def kmeans(x: np.ndarray, k: int, steps: int = 50, seed: int = 0) -> np.ndarray:
    """Cluster of each row; the first centres are spread out, empty clusters take the farthest row."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        centres.append(x[np.argmax(np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0))])
    c = np.array(centres)
    label = np.zeros(len(x), int)
    for _ in range(steps):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        new = d.argmin(axis=1)
        c = np.array([x[new == i].mean(axis=0) if (new == i).any() else x[d.min(axis=1).argmax()] for i in range(k)])
        if (new == label).all():
            break
        label = new
    return label



def cells(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]], "i int, j int, x double")


def dense(factor, n, rank):
    out = np.zeros((n, rank))
    for r in factor.collect():
        out[r.i] = r.v
    return out


def test_updates_equal_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.poisson(1.0, (9, 7)).astype(float)
    m[:, 3] += 1
    m[2] += 1
    table = cells(spark, m)
    w = dense(fa.seeded(table.select("i").distinct(), 3, "nmf-w"), 9, 3)
    h = dense(fa.seeded(table.selectExpr("j as i").distinct(), 3, "nmf-h"), 7, 3).T
    want = []
    for _ in range(4):
        h *= (w.T @ m) / (w.T @ w @ h + 1e-10)
        w *= (m @ h.T) / (w @ h @ h.T + 1e-10)
        want.append(((m - w @ h) ** 2).sum())
    got_w, got_h, losses = fa.nmf(table, 3, 4)
    assert np.allclose(dense(got_w, 9, 3), w) and np.allclose(dense(got_h, 7, 3).T, h)
    assert losses == pytest.approx(want) and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))


def blocks():
    m = np.kron(np.eye(3), np.ones((6, 6))) * 5 + 0.1
    m[0, 7] = m[7, 0] = 1.0
    return m


def test_spectral_coordinates_and_clusters(spark):
    m = blocks()
    q, values = fa.spectral(cells(spark, m), 3, 25)
    d = 1 / np.sqrt(m.sum(axis=1))
    true_values, vectors = np.linalg.eigh(d[:, None] * m * d[None])
    assert values == pytest.approx((1 + true_values[::-1][:3]) / 2, abs=1e-4)
    mine = dense(q, 18, 3)
    assert np.allclose(mine.T @ mine, np.eye(3), atol=1e-6)
    # the same space
    top = vectors[:, ::-1][:, :3]
    assert np.allclose(mine @ mine.T, top @ top.T, atol=1e-3)
    labels, centres = fa.kmeans(q, 3, 3)
    got = {r.i: r.label for r in labels.collect()}
    want = kmeans(top, 3)
    same = lambda x: {(i, j) for i in range(18) for j in range(18) if x[i] == x[j]}
    assert same(got) == same(want)
    assert fa.simplified_silhouette(labels, centres) > 0.9


def test_cooccurrence_within_a_window(spark):
    docs = spark.createDataFrame([(["a", "b", "a", "c", "x"],), (["b"],), ([],)], "toks array<string>")
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "tok string, i int")
    got = {(r.i, r.j): r.x for r in fa.cooccurrence(docs, words, 2).collect()}
    assert got == {(0, 1): 2.0, (1, 0): 2.0, (0, 0): 2.0, (0, 2): 1.0, (2, 0): 1.0, (1, 2): 1.0, (2, 1): 1.0}


def test_few_points(spark):
    one = spark.createDataFrame([(4, [1.0, 2.0])], "i int, v array<double>")
    labels, centres = fa.kmeans(one, 3, 2)
    assert [(r.i, r.label) for r in labels.collect()] == [(4, 0)] and fa.simplified_silhouette(labels, centres) == 0.0
    assert fa.kmeans(one.limit(0), 3, 2)[0].count() == 0
