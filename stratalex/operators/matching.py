"""Matching of tokens with a dictionary by phonetic keys, and context scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.functions.text import fuzzy_reach, segments, skeleton
from stratalex.operators.decode import bounded
from stratalex.sources.tables import fixed


def skeleton_index(words: DataFrame) -> DataFrame:
    """(skel, word, freq, rank): dictionary words under their skeleton, by falling frequency then word."""
    rows = words.withColumn("skel", skeleton(F.col("word"))).where("skel <> ''")
    w = Window.partitionBy("skel").orderBy(F.desc("freq"), "word")
    return rows.withColumn("rank", F.row_number().over(w))


def exact_matches(types: DataFrame, index: DataFrame) -> DataFrame:
    """(tok, skel, word, freq, dist): words whose skeleton equals the token's. ``types`` has distinct (tok, skel)."""
    return types.join(index.select("skel", "word", "freq"), "skel").withColumn("dist", F.lit(0))


def fuzzy_matches(types: DataFrame, index: DataFrame) -> DataFrame:
    """Words within the reach of skeletons that have no equal one.

    Distances are taken between distinct skeletons only. The reach is one edit
    of the joined text, which can change one segment but not add any; so
    candidates have as many segments and agree in all but one. They meet by
    equi-joins on the skeleton with one segment left out, not by comparing all.
    """
    own = index.select("skel").distinct()
    asked = types.select("skel").distinct().where(fuzzy_reach(F.col("skel")) > 0).join(own, "skel", "left_anti")

    def holes(skel: Column) -> Column:
        parts = F.split(skel, "-")
        return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("-", F.transform(parts, lambda p, j: F.when(i == j, F.lit("_")).otherwise(p))))

    left = asked.select("skel", F.explode(holes(F.col("skel"))).alias("hole"))
    right = own.where(segments(F.col("skel")) > 4).select(F.col("skel").alias("near"), F.explode(holes(F.col("skel"))).alias("hole"))
    pairs = left.join(right, "hole").select("skel", "near").distinct().withColumn("dist", F.levenshtein("skel", "near")).where("dist <= 1")
    words = pairs.join(index.select(F.col("skel").alias("near"), "word", "freq"), "near")
    return types.join(words, "skel").select("tok", "skel", "word", "freq", "dist")


def nearest_resolved(tokens: DataFrame) -> DataFrame:
    """``tokens`` (doc_id, pos, word or null, ...) with left, left_gap, right, right_gap: the nearest word on each side.

    Both sides look back, the right one from the end: a frame that shrinks from
    the front would be summed anew for each row.
    """
    at = F.when(F.col("word").isNotNull(), F.struct("word", "pos"))
    back = (Window.unboundedPreceding, -1)
    before = F.last(at, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(*back))
    after = F.last(at, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(*back))
    rows = tokens.withColumn("l", before).withColumn("r", after)
    return rows.select(
        *tokens.columns, F.col("l.word").alias("left"), (F.col("pos") - F.col("l.pos")).alias("left_gap"),
        F.col("r.word").alias("right"), (F.col("r.pos") - F.col("pos")).alias("right_gap"),
    )


#: Words of a dictionary that tasks may hold.
MOST_WORDS = 2_000_000


def open_between(docs: DataFrame, words: DataFrame, gap: int) -> DataFrame:
    """(doc_id, pos, tok, lt, rt): words of ``docs`` (doc_id, toks) that ``words`` (word, tag) has not, within ``gap`` places of one it has on both sides, with the tags of the nearest ones.

    What ``nearest_resolved`` finds, in the row: tasks hold the words, whose number is checked.
    """
    rows = bounded(words.select("word", "tag"), MOST_WORDS, "the dictionary")
    held = docs.sparkSession.sparkContext.broadcast(([r["word"] for r in rows], [r["tag"] for r in rows]))

    def run(batches):
        known, tags = (pa.array(x, pa.string()) for x in held.value)
        for batch in batches:
            lists = batch.column("toks")
            toks, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(toks, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at, row = np.arange(len(code)), np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes)
            left = np.maximum.accumulate(np.where(code >= 0, at, -1))
            right = np.minimum.accumulate(np.where(code >= 0, at, len(code))[::-1])[::-1]
            pick = np.flatnonzero((code < 0) & (left >= (ends - sizes)[row]) & (right < ends[row]) & (at - left <= gap) & (right - at <= gap))
            cols = [batch.column("doc_id").take(pa.array(row[pick])), pa.array(pick - (ends - sizes)[row[pick]]), toks.take(pa.array(pick)), *(tags.take(pa.array(code[x[pick]])) for x in (left, right))]
            yield pa.record_batch(cols, names=["doc_id", "pos", "tok", "lt", "rt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "toks").mapInArrow(run, "doc_id long, pos long, tok string, lt string, rt string")


def context_scores(open_: DataFrame, candidates: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Best and second candidate of each distinct context (left, tok, right) of ``open_``.

    A context that comes a million times is scored once. The score of a
    candidate is P(c | left) + P(right | c).
    """
    ctx = open_.groupBy("left", "tok", "right").agg(F.count(F.lit(1)).alias("n"))
    cand = ctx.join(candidates.select("tok", "word"), "tok")
    p = bigrams.select("w1", "w2", "p")
    cand = cand.join(p.select(F.col("w1").alias("left"), F.col("w2").alias("word"), F.col("p").alias("pl")), ["left", "word"], "left")
    cand = cand.join(p.select(F.col("w1").alias("word"), F.col("w2").alias("right"), F.col("p").alias("pr")), ["word", "right"], "left")
    cand = cand.withColumn("score", F.coalesce("pl", F.lit(0.0)) + F.coalesce("pr", F.lit(0.0)))
    w = Window.partitionBy("left", "tok", "right").orderBy(F.desc("score"), "word")
    ranked = cand.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    kinds = F.count("score").over(Window.partitionBy("left", "tok", "right"))
    nonzero = F.count_if(F.col("score") > 0).over(Window.partitionBy("left", "tok", "right"))
    ranked = ranked.withColumn("candidates", kinds).withColumn("nonzero", nonzero)
    return ranked.where("rank = 1").select("left", "tok", "right", "n", "word", "score", "second", "candidates", "nonzero")


def pair_lists(index: DataFrame, bigrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, skel, before) and (skel, right, after): the words of a skeleton that are known after a word, and before one, with p.

    A list is no longer than its skeleton has words in ``index`` (skel, word);
    both tables have as many entries as there are known pairs.
    """
    own = index.select("skel", "word")
    entry = F.collect_list(F.struct("word", "p"))
    before = bigrams.select(F.col("w1").alias("left"), F.col("w2").alias("word"), "p").join(own, "word").groupBy("left", "skel").agg(entry.alias("before"))
    after = bigrams.select(F.col("w1").alias("word"), F.col("w2").alias("right"), "p").join(own, "word").groupBy("skel", "right").agg(entry.alias("after"))
    return before, after


def pair_scores(before: Column, after: Column) -> Column:
    """(s, w) of each word of either list: s is -(P(w | left) + P(right | w)); the best first, then by word."""
    b, a = (F.coalesce(x, F.array().cast("array<struct<word:string,p:double>>")) for x in (before, after))
    p = lambda side, w: F.coalesce(F.get(F.filter(side, lambda x: x["word"] == w), F.lit(0))["p"], F.lit(0.0))
    words = F.array_union(F.transform(b, lambda x: x["word"]), F.transform(a, lambda x: x["word"]))
    return F.sort_array(F.transform(words, lambda w: F.struct((-(p(b, w) + p(a, w))).alias("s"), w.alias("w"))))


def likely(open_: DataFrame, index: DataFrame, bigrams: DataFrame) -> DataFrame:
    """The rows of ``open_`` (skel, left, right, ...) with a candidate of some score, with word, score, second and nonzero.

    Only known pairs give a score, so a row meets the pairs of its neighbours
    that have a word of its skeleton, not all candidates; the others are out
    before anything is ranked, and no context is moved to be grouped.
    """
    before, after = pair_lists(index, bigrams)
    rows = open_.join(before, ["left", "skel"], "left").join(after, ["skel", "right"], "left").where("before is not null or after is not null")
    rows = fixed(rows.select(*open_.columns, pair_scores(F.col("before"), F.col("after")).alias("hits")), *open_.columns, "hits")
    second = F.coalesce(-F.get("hits", F.lit(1))["s"], F.lit(0.0))
    return rows.select(*open_.columns, F.get("hits", F.lit(0))["w"].alias("word"), (-F.get("hits", F.lit(0))["s"]).alias("score"), second.alias("second"), F.size("hits").cast("long").alias("nonzero"))


def confidence_threshold(segs: Column, nonzero: Column, dual: Column, boosted: Column | None = None, ratio: Column | float = 5.0, near: Column | float = 0.6) -> Column:
    """The ratio of best to second that accepts a candidate.

    ``ratio``, or 3 (``ratio`` if that is less) from five segments on; times 0.75 for two candidates with a score
    and 0.9 for up to five; times ``near`` with both neighbours near; times 0.5 for
    a boosted winner; 1.5 at least.
    """
    ratio, near = (x if isinstance(x, Column) else F.lit(x) for x in (ratio, near))
    t = F.when(segs >= 5, F.least(F.lit(3.0), ratio)).otherwise(ratio)
    t = t * F.when(nonzero == 2, 0.75).when(nonzero <= 5, 0.9).otherwise(1.0)
    t = t * F.when(dual, near).otherwise(1.0)
    if boosted is not None:
        t = t * F.when(boosted, 0.5).otherwise(1.0)
    return F.greatest(t, F.lit(1.5))


def consensus(resolved: DataFrame, least: int = 3, agreement: float = 0.6) -> DataFrame:
    """(skel, word, c, total): the majority word of each skeleton of ``resolved`` (skel, word), ties by word."""
    return majority(resolved.groupBy("skel", "word").agg(F.count(F.lit(1)).alias("c")), least, agreement)


def majority(c: DataFrame, least: int = 3, agreement: float = 0.6) -> DataFrame:
    """As ``consensus``, from counts (skel, word, c)."""
    w = Window.partitionBy("skel")
    top = c.withColumn("total", F.sum("c").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("c"), "word")))
    return top.where((F.col("rank") == 1) & (F.col("total") >= least) & (F.col("c") / F.col("total") >= agreement)).select("skel", "word", "c", "total")


def binomial_tail(k: Column, m: Column, p: Column) -> Column:
    """P(Bin(m, p) >= k) without a table: the incomplete beta function by its continued fraction. 1 for k <= 0 or p >= 1, 0 for k > m or p <= 0.

    The fraction goes on until it no longer changes, for all rows of a batch at
    once; its turns grow with the root of m at most.
    """
    k, m, p = k.cast("double"), m.cast("double"), p.cast("double")

    def log_gamma(z):
        w = z + 10
        series = (w - 0.5) * np.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5)
        return series - sum(np.log(z + i) for i in range(10))

    def fraction(u, v, x):
        """Lentz's scheme, two terms a turn: the value and the two running ratios."""
        safe = lambda z: np.where(np.abs(z) < 1e-300, 1e-300, z)
        d, c = 1 / safe(1 - (u + v) * x / (u + 1)), np.ones_like(x)
        h = d
        for j in range(1, 61 + math.ceil(6 * math.sqrt(max(u.max(), v.max())))):
            even = j * (v - j) * x / ((u + 2 * j - 1) * (u + 2 * j))
            odd = -(u + j) * (u + v + j) * x / ((u + 2 * j) * (u + 2 * j + 1))
            d, c = 1 / safe(1 + even * d), safe(1 + even / c)
            h = h * d * c
            d, c = 1 / safe(1 + odd * d), safe(1 + odd / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        return h

    def tail(k: pd.Series, m: pd.Series, p: pd.Series) -> pd.Series:
        k, m, p = (np.asarray(x, float) for x in (k, m, p))
        out = np.where((k <= 0) | (p >= 1), 1.0, 0.0)
        at = np.flatnonzero((k > 0) & (k <= m) & (p > 0) & (p < 1))
        if len(at):
            a, b, q = k[at], m[at] - k[at] + 1, p[at]
            # the fraction converges fast on the side of the mean where x is small
            turned = q > (a + 1) / (a + b + 2)
            u, v, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - q, q)
            part = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(q) + b * np.log1p(-q)) / u * fraction(u, v, x)
            out[at] = np.clip(np.where(turned, 1 - part, part), 0.0, 1.0)
        return pd.Series(out)

    return F.when(k.isNotNull() & m.isNotNull() & p.isNotNull(), F.pandas_udf(tail, "double")(k, m, p))
