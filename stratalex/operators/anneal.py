"""A mapping of words to words by replica exchange: chains at several temperatures, which trade places.

A mapping costs what the transition tables differ under it, and for cribs it
breaks, ranks it moves and topics it tears apart. Every change is priced by the
rows and columns that it touches, never by the whole tables. Replicas run as
rows of a table; between rounds neighbours in temperature trade by their costs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalex.session import Tables

#: Weights of the four parts of the cost, and how far apart in rank two words of a topic may be to be looked at.
WEIGHTS, TOPIC_REACH = (1.0, 0.5, 0.3, 0.2), 20


@dataclass
class Problem:
    """Transition tables of n and of m words in order of rank; images allowed for each word (none: all); pairs of words of a topic; pairs of images that go together."""

    p: np.ndarray
    q: np.ndarray
    cribs: np.ndarray | None = None
    topics: np.ndarray | None = None
    together: np.ndarray | None = None
    weights: tuple[float, float, float, float] = WEIGHTS

    def __post_init__(self) -> None:
        n, m = len(self.p), len(self.q)
        cribs = np.ones((n, m), bool) if self.cribs is None else self.cribs.astype(bool)
        #: What an image costs a word by itself: its crib and its rank.
        ranks = np.abs(np.arange(n)[:, None] - np.arange(m)[None]) / max(n, 1)
        self.alone = self.weights[1] * (~cribs & cribs.any(axis=1, keepdims=True)) + self.weights[2] * ranks
        near = np.abs(np.arange(n)[:, None] - np.arange(n)[None])
        same = np.zeros((n, n), bool) if self.topics is None else self.topics.astype(bool)
        self.pairs = (same | same.T) & (near > 0) & (near < TOPIC_REACH)
        self.apart = np.zeros((m, m)) if self.together is None else (~(self.together | self.together.T)).astype(float)
        self.share = self.weights[3] / max(1, int(self.pairs.sum()) // 2)
        self.turned_p, self.turned_q = np.ascontiguousarray(self.p.T), np.ascontiguousarray(self.q.T)

    def cost(self, image: np.ndarray) -> float:
        gap = ((self.p - self.q[np.ix_(image, image)]) ** 2).sum()
        torn = (self.apart[np.ix_(image, image)] * self.pairs).sum() / 2
        return float(self.weights[0] * gap + self.alone[np.arange(len(image)), image].sum() + self.share * torn)

    def delta(self, image: np.ndarray, i: int, new: int) -> float:
        """What it costs more to send word ``i`` to ``new``."""
        old = image[i]
        row = (self.p[i] - self.q[new][image]) ** 2 - (self.p[i] - self.q[old][image]) ** 2
        row += (self.turned_p[i] - self.turned_q[new][image]) ** 2 - (self.turned_p[i] - self.turned_q[old][image]) ** 2
        own = (self.p[i, i] - self.q[new, new]) ** 2 - (self.p[i, i] - self.q[old, old]) ** 2
        torn = ((self.apart[new] - self.apart[old])[image] * self.pairs[i]).sum()
        return float(self.weights[0] * (row.sum() - row[i] + own) + self.alone[i, new] - self.alone[i, old] + self.share * torn)

    def start(self) -> np.ndarray:
        """Each word in order of rank gets its first crib that is free, else the first free image, else its own rank again."""
        n, m = len(self.p), len(self.q)
        free, image = np.ones(m, bool), np.arange(n) % max(m, 1)
        for i in range(n):
            own = np.flatnonzero(free & (self.cribs[i] if self.cribs is not None and self.cribs[i].any() else True))
            own = own if len(own) else np.flatnonzero(free)
            if len(own):
                image[i] = own[0]
                free[own[0]] = False
        return image

    def walk(self, image: np.ndarray, cost: float, heat: float, steps: int, rng: np.random.Generator, swaps: bool) -> tuple[np.ndarray, float, np.ndarray, float]:
        """``steps`` changes at one temperature; the last mapping and the best one, each with its cost."""
        image, best, least = image.copy(), image.copy(), cost
        n, m = len(self.p), len(self.q)
        if n < 1 or m < 1:
            return image, cost, best, least
        first, second, luck = rng.integers(0, n, steps), rng.integers(0, n if swaps else m, steps), rng.random(steps)
        for i, k, u in zip(first.tolist(), second.tolist(), luck.tolist()):
            old = int(image[i])
            new = int(image[k]) if swaps else k
            if old == new:
                continue
            more = self.delta(image, i, new)
            image[i] = new
            if swaps:
                more += self.delta(image, k, old)
                image[k] = old
            if more <= 0 or u < np.exp(-more / heat):
                cost += more
                if cost < least - 1e-12:
                    best, least = image.copy(), cost
            else:
                image[i] = old
                if swaps:
                    image[k] = new
        return image, cost, best, least


def exchange(spark: SparkSession, problem: Problem, chains: int = 4, levels: int = 6, steps: int = 100_000, rounds: int = 20, hot: float = 1.0, cold: float = 0.001, swaps: bool = True) -> DataFrame:
    """(chain, cost, image): the best mapping of each chain of ``levels`` temperatures after ``steps`` changes of each replica.

    A replica is a row, and a round is a table in the shared folder, so a lost
    executor costs a round at most. After a round neighbours in temperature (in turn 0-1, 2-3,
    ... and 1-2, 3-4, ...) trade places with the chance that their costs and
    temperatures give. Draws follow from chain, level and round alone.
    """
    held = spark.sparkContext.broadcast(problem)
    heats = [hot * (cold / hot) ** (k / max(1, levels - 1)) for k in range(levels)]
    each = -(-steps // rounds)
    kind = "chain int, level int, image array<int>, cost double, best array<int>, least double"

    def run(at: int):
        def move(frames):
            own = held.value
            for f in frames:
                rows = []
                for chain, level, image, cost, best, least in f.itertuples(index=False):
                    rng = np.random.default_rng([chain, level, at])
                    image = np.asarray(image, int)
                    if at == 0 and chain:
                        image = rng.permutation(image)
                    # sums of differences drift by rounding; a round begins from the cost itself
                    cost = own.cost(image)
                    image, cost, found, low = own.walk(image, cost, heats[level], each, rng, swaps)
                    best, least = (found, low) if low < least else (best, least)
                    rows.append((chain, level, image.tolist(), cost, list(best), least))
                yield pd.DataFrame(rows, columns=["chain", "level", "image", "cost", "best", "least"])

        return move

    first = problem.start().tolist()
    cost = problem.cost(np.array(first, int))
    state = spark.createDataFrame([(c, k, first, cost, first, cost) for c in range(chains) for k in range(levels)], kind)
    tables, before = Tables(spark), None
    for at in range(rounds):
        done = state.repartition(chains * levels, "chain", "level").mapInPandas(run(at), kind)
        by = Window.partitionBy("chain").orderBy("level")
        # the warmer of a pair tells both whether they trade
        heat = F.element_at(F.array(*map(F.lit, heats)), F.col("level") + 1)
        colder = F.lead("cost").over(by)
        gain = (1 / F.lead(heat).over(by) - 1 / heat) * (colder - F.col("cost"))
        luck = F.conv(F.substring(F.md5(F.concat_ws("|", "chain", "level", F.lit(at))), 1, 12), 16, 10).cast("double") / 16.0**12
        trades = F.coalesce((F.col("level") % 2 == at % 2) & colder.isNotNull() & (luck < F.exp(F.least(gain, F.lit(0.0)))), F.lit(False))
        done = done.withColumn("up", trades).withColumn("down", F.coalesce(F.lag("up").over(by), F.lit(False)))
        moved = F.col("level") + F.when(F.col("up"), 1).when(F.col("down"), -1).otherwise(0)
        fresh = Tables(spark)
        state = fresh.put(done.withColumn("level", moved.cast("int")).select("chain", "level", "image", "cost", "best", "least"), "replicas")
        if before:
            before.drop()
        before = fresh
    tables.paths += before.paths if before else []
    result = state.groupBy("chain").agg(F.min("least").alias("cost"), F.min_by("best", "least").alias("image"))
    rows = result.collect()  # one row a chain
    tables.drop()
    return spark.createDataFrame([tuple(r) for r in rows], "chain int, cost double, image array<int>")
