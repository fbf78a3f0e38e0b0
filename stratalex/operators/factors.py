"""Factors and spectral coordinates of a sparse table of words, at vocabulary size.

A matrix is a table (i, j, x) of its cells, a factor a table (i, v) of short
arrays, a row a word. Products are joins and sums by row; only matrices of
rank x rank go through the driver. A step writes its tables, the step before drops its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.operators.decode import bounded
from stratalex.session import Tables


#: Words that tasks may hold, and up to how many a task adds up its pairs in one table.
MOST_WORDS, DENSE_WORDS = 200_000, 4096


def cooccurrence(docs: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """(i, j, x): how often words (tok, i) stand within ``window`` places of each other in ``docs`` (toks), both ways.

    Tasks hold the words, whose number is checked, and add up pairs of them by
    number; pairs of other words are never made.
    """
    rows = bounded(words.select("tok", "i"), MOST_WORDS, "the list of words")
    held = docs.sparkSession.sparkContext.broadcast(([r["tok"] for r in rows], [r["i"] for r in rows]))

    def run(batches):
        toks, numbers = pa.array(held.value[0], pa.string()), np.array(held.value[1], np.int64)
        size = len(toks)
        total = np.zeros(size * size, np.int64) if size <= DENSE_WORDS else None

        def cells(key, n):
            return pa.record_batch([pa.array(x) for x in (numbers[key // size], numbers[key % size], n)], names=["i", "j", "n"])

        for batch in batches:
            lists = batch.column("toks")
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=toks), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            # only the words of the list are kept, each with its place
            at = np.flatnonzero(code >= 0)
            code, row = code[at], row[at]
            for k in range(1, min(window, max(0, len(at) - 1)) + 1):
                near = (at[k:] - at[:-k] <= window) & (row[k:] == row[:-k])
                a, b = code[:-k][near], code[k:][near]
                key = np.minimum(a, b) * size + np.maximum(a, b)
                if total is not None:
                    total += np.bincount(key, minlength=size * size)
                elif len(key):
                    yield cells(*np.unique(key, return_counts=True))
        if total is not None:
            key = np.flatnonzero(total)
            yield cells(key, total[key])

    one = docs.select("toks").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = one.select(F.inline(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n"))))
    kinds = dict(words.dtypes)["i"]
    return both.groupBy(F.col("i").cast(kinds).alias("i"), F.col("j").cast(kinds).alias("j")).agg(F.sum("n").cast("double").alias("x"))


def seeded(rows: DataFrame, rank: int, seed: str) -> DataFrame:
    """(i, v): numbers between 0.1 and 1.1 for each row, by hashes of its number."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("i"), F.lit(k)), F.lit(1 << 40)) / float(1 << 40) + 0.1
    return rows.select("i", F.array(*(draw(k) for k in range(rank))).alias("v"))


def _sums(v: Column, rank: int) -> Column:
    """The sum of arrays, place by place."""
    return F.array(*(F.sum(F.get(v, F.lit(k))) for k in range(rank)))


def product(cells: DataFrame, factor: DataFrame, rank: int, by: str = "i", over: str = "j") -> DataFrame:
    """(i, v): the matrix (its transpose for ``by`` j) times a factor, as one sum a row."""
    scaled = cells.join(factor.select(F.col("i").alias(over), "v"), over).select(F.col(by).alias("i"), F.transform("v", lambda a: a * F.col("x")).alias("v"))
    return scaled.groupBy("i").agg(_sums(F.col("v"), rank).alias("v"))


def gram(factor: DataFrame, rank: int) -> np.ndarray:
    """The products of a factor's columns: rank x rank numbers."""
    cells = [F.sum(F.get("v", F.lit(a)) * F.get("v", F.lit(b))) for a in range(rank) for b in range(rank)]
    row = factor.agg(*(c.alias(f"c{k}") for k, c in enumerate(cells))).first()
    return np.array([c or 0.0 for c in row], float).reshape(rank, rank)


def times(v: Column, matrix: np.ndarray) -> Column:
    """An array times a small matrix of numbers."""
    return F.array(*(sum((F.get(v, F.lit(a)) * float(matrix[a, b]) for a in range(matrix.shape[0])), F.lit(0.0)) for b in range(matrix.shape[1])))


def _updated(factor: DataFrame, top: DataFrame, square: np.ndarray) -> DataFrame:
    """A factor by one multiplicative update; rows that ``top`` has not are zero from then on."""
    rank = len(square)
    joined = factor.join(top.select("i", F.col("v").alias("t")), "i", "left")
    down, up = times(F.col("v"), square), F.coalesce("t", F.array(*[F.lit(0.0)] * rank))
    return joined.select("i", F.zip_with(F.zip_with("v", up, lambda a, b: a * b), down, lambda a, b: a / (b + 1e-10)).alias("v"))


def nmf(cells: DataFrame, rank: int, steps: int, seed: str = "nmf") -> tuple[DataFrame, DataFrame, list[float]]:
    """(w, h, losses) of a table of non-negative cells: both factors as (i, v), and the squared error after each step.

    Multiplicative updates, h before w. The error comes from the cells' squares, the
    products where there are cells and the small matrices: the dense product is never made.
    """
    spark = cells.sparkSession
    base = Tables(spark)
    cells = base.put(cells, "cells")
    w = base.put(seeded(cells.select("i").distinct(), rank, f"{seed}-w"), "w")
    h = base.put(seeded(cells.select(F.col("j").alias("i")).distinct(), rank, f"{seed}-h"), "h")
    squares = cells.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    losses, before = [], Tables(spark)
    for _ in range(steps):
        fresh = Tables(spark)
        h = fresh.put(_updated(h, product(cells, w, rank, "j", "i"), gram(w, rank)), "h")
        top = fresh.put(product(cells, h, rank), "top")
        hh = gram(h, rank)
        w = fresh.put(_updated(w, top, hh), "w")
        inner = w.join(top.select("i", F.col("v").alias("t")), "i").agg(F.sum(F.aggregate(F.zip_with("v", "t", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a))).first()[0] or 0.0
        losses.append(float(squares - 2 * inner + (gram(w, rank) * hh).sum()))
        before.drop()
        before = fresh
    base.drop()
    return w, h, losses


def spectral(cells: DataFrame, rank: int, steps: int, seed: str = "spectral") -> tuple[DataFrame, np.ndarray]:
    """(coordinates, values): the ``rank`` largest directions of a symmetric table scaled by its rows' sums, (I + S) / 2 of them, as (i, v).

    Orthogonal iteration: a product, then the columns are turned to be orthonormal and in order, by the eigenvectors of their small matrix of products.
    """
    spark, base = cells.sparkSession, Tables(cells.sparkSession)
    sums = base.put(cells.groupBy("i").agg(F.sum("x").alias("d")).where("d > 0"), "sums")
    d = lambda k: sums.select(F.col("i").alias(k), F.col("d").alias(f"d{k}"))
    scaled = base.put(cells.join(d("i"), "i").join(d("j"), "j").select("i", "j", (F.col("x") / F.sqrt(F.col("di") * F.col("dj"))).alias("x")), "scaled")
    q = base.put(seeded(sums.select("i"), rank, seed), "q")
    before, values = Tables(spark), np.zeros(rank)
    for step in range(steps + 1):
        fresh = Tables(spark)
        y = q
        if step:
            # half the sum with itself, so that no eigenvalue is negative and the largest come first
            more = q.join(product(scaled, q, rank).withColumnRenamed("v", "t"), "i", "left")
            y = fresh.put(more.select("i", F.when(F.col("t").isNull(), F.transform("v", lambda a: a / 2)).otherwise(F.zip_with("v", "t", lambda a, b: (a + b) / 2)).alias("v")), "y")
        g = gram(y, rank)
        values, turn = np.linalg.eigh(g)
        values, turn = values[::-1], turn[:, ::-1]
        back = turn / np.sqrt(np.maximum(values, 1e-300))
        q = fresh.put(y.select("i", times(F.col("v"), back).alias("v")), "q")
        before.drop()
        before = fresh
    base.drop()
    return q, np.sqrt(np.maximum(values, 0))


def kmeans(points: DataFrame, k: int, rank: int, steps: int = 10, rounds: int = 3, seed: str = "kmeans") -> tuple[DataFrame, np.ndarray]:
    """(labels, centres): (i, v, label, far) of ``points`` (i, v), by k-means with k-means|| for its first centres.

    A round draws about 2k points with chances that follow their distance; the
    drawn ones (a bounded number) are weighed by the points nearest to them and clustered on the driver.
    """
    spark, base = points.sparkSession, Tables(points.sparkSession)
    points = base.put(points, "points")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(0), F.col("i")), F.lit(1 << 40)) / float(1 << 40)
    drawn = [list(r["v"]) for r in points.orderBy(chance, "i").limit(1).collect()]
    for r in range(1, rounds + 1):
        if not drawn:
            break
        far = _nearest(points, np.array(drawn))
        total = far.agg(F.sum("far")).first()[0] or 0.0
        if total <= 1e-12:
            break
        luck = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col("i")), F.lit(1 << 40)) / float(1 << 40)
        more = far.where(luck * total < 2 * k * F.col("far")).orderBy(F.desc("far"), "i").limit(8 * k).collect()
        drawn += [list(x["v"]) for x in more]
    centres = np.array(drawn).reshape(len(drawn), rank)
    if len(centres) > k:
        weights = {x["label"]: x["n"] for x in _nearest(points, centres).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        centres = _weighted(centres, np.array([weights.get(c, 0) for c in range(len(centres))], float), k)
    for _ in range(steps if len(centres) else 0):
        sums = _nearest(points, centres).groupBy("label").agg(F.count(F.lit(1)).alias("n"), _sums(F.col("v"), rank).alias("s")).collect()
        new = centres.copy()
        for x in sums:
            new[x["label"]] = np.array(x["s"]) / x["n"]
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    labels = Tables(spark).put(_nearest(points, centres) if len(centres) else points.withColumns({"label": F.lit(0), "far": F.lit(0.0)}), "labels")
    base.drop()
    return labels, centres


def _nearest(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with the number of the nearest centre and its squared distance."""
    held = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))
    gaps = F.transform(held, lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, a: s + a))
    return points.select("i", "v", gaps.alias("gaps")).select("i", "v", (F.array_position("gaps", F.array_min("gaps")) - 1).cast("int").alias("label"), F.array_min("gaps").alias("far"))


def _weighted(x: np.ndarray, weight: np.ndarray, k: int, steps: int = 30) -> np.ndarray:
    """k centres of a few weighted points; the first is the heaviest, the next the farthest by weight."""
    c = [x[weight.argmax()]]
    while len(c) < k:
        c.append(x[(np.min([((x - y) ** 2).sum(axis=1) for y in c], axis=0) * np.maximum(weight, 1e-9)).argmax()])
    c = np.array(c)
    for _ in range(steps):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([np.average(x[label == i], axis=0, weights=weight[label == i]) if weight[label == i].sum() > 0 else c[i] for i in range(k)])
    return c


def simplified_silhouette(labels: DataFrame, centres: np.ndarray) -> float:
    """Mean over all points of how much nearer their own centre is than the next one, by distances to centres."""
    if len(centres) < 2:
        return 0.0
    held = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))
    gaps = F.sort_array(F.transform(held, lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, a: s + a))))
    a, b = F.get(gaps, F.lit(0)), F.get(gaps, F.lit(1))
    return float(labels.agg(F.avg((b - a) / F.greatest(b, F.lit(1e-12)))).first()[0] or 0.0)
