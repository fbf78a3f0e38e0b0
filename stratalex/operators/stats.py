"""Statistics of sign and word sequences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.sources.tables import fixed, neighbours


def bits(c: Column | str) -> Column:
    """Entropy in bits of a group's counts: log2(T) - sum(c log2 c) / T."""
    c = F.col(c) if isinstance(c, str) else c
    return F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)


def chars_of(toks: Column) -> Column:
    """All letters of a token array in a row: letters run across words."""
    return F.filter(F.split(F.concat_ws("", toks), ""), lambda c: c != "")


def char_grams(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, p2, p1, ch, n): counts of each letter with the two before it, null at a document's start.

    Letters run across words. Words are counted first, each with the two
    letters before it, so letters are taken apart once for each distinct such
    pair; the counts that are shuffled last have 27^3 rows a key at most.
    """
    return grams_of(words_after(docs, *keys), *keys)


def words_after(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, ctx, tok, n): words with the two letters before them, fewer at a document's start."""
    t = F.col("toks")
    at = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    before = lambda i: F.concat(F.coalesce(F.get(t, i - 2), F.lit("")), F.coalesce(F.get(t, i - 1), F.lit("")))
    words = docs.select(*keys, F.explode(F.transform(at, lambda i: F.struct(F.right(before(i), F.lit(2)).alias("ctx"), F.get(t, i).alias("tok")))).alias("w"))
    return words.groupBy(*keys, "w.ctx", "w.tok").agg(F.count(F.lit(1)).alias("n"))


def grams_of(counts: DataFrame, *keys: str) -> DataFrame:
    """What ``char_grams`` gives, of ``words_after``."""
    rows = fixed(
        counts.select(*keys, "n", F.length("ctx").alias("k"), F.filter(F.split(F.concat("ctx", "tok"), ""), lambda c: c != "").alias("c")),
        *keys, "n", "k", "c",
    )
    each = F.transform(
        F.sequence(F.col("k"), F.size("c") - 1),
        lambda i: F.struct(F.get("c", i - 2).alias("p2"), F.get("c", i - 1).alias("p1"), F.get("c", i).alias("ch")),
    )
    grams = rows.select(*keys, "n", F.explode(each).alias("g"))
    return grams.groupBy(*keys, "g.p2", "g.p1", "g.ch").agg(F.sum("n").alias("n"))


def char_entropies(grams: DataFrame, *keys: str) -> DataFrame:
    """(keys, h1, h2, h3): entropy of a letter, and given one and two letters before it.

    All orders come from one pass over the counts: each gives its share to a
    letter, its pair, its triple and their contexts.
    """
    kinds = {"a": ["ch"], "b": ["p1", "ch"], "bc": ["p1"], "t": ["p2", "p1", "ch"], "tc": ["p2", "p1"]}
    # concat is null where a letter before is missing
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(*([F.col("p1")] if k == "bc" else map(F.col, cols))).alias("g")) for k, cols in kinds.items()))
    rows = grams.select(*keys, "n", F.inline(parts)).where("g is not null").groupBy(*keys, "kind", "g").agg(F.sum("n").alias("n"))
    h = rows.groupBy(*keys, "kind").agg(bits("n").alias("h"))
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("h")))
    out = h.groupBy(*keys).agg(*(at(k).alias(k) for k in kinds))
    return out.where("tc is not null").select(*keys, F.col("a").alias("h1"), (F.col("b") - F.col("bc")).alias("h2"), (F.col("t") - F.col("tc")).alias("h3"))


def letter_entropies(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, h1, h2) of ``docs`` (keys, letters): entropy of a letter a-z, and given the one before it, of all rows of equal keys.

    A row's pairs of letters are counted in its task; what moves is a list of at most 26 x 27 counts a row.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def counted(batches):
        for batch in batches:
            # the last letter of a row has none after it, number 26
            ends = np.cumsum([len(x) for x in batch.column("letters").to_pylist()])
            c = np.frombuffer("".join(batch.column("letters").to_pylist()).encode(), np.uint8).astype(np.int64) - 97
            after = np.append(c[1:], 26)
            after[ends - 1] = 26
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            cells, n = np.unique((row * 26 + c) * 27 + after, return_counts=True)
            at = pa.array(np.searchsorted(cells, np.arange(len(ends) + 1) * 702).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((cells % 702).astype(np.int16), n)]
            yield pa.record_batch([*(batch.column(k) for k in keys), *lists], names=[*keys, "g", "n"])

    def entropies(batches):
        bits = lambda n: (n * np.log2(np.maximum(n, 1))).sum(axis=1)
        for batch in batches:
            g, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in "gn")
            row = np.repeat(np.arange(batch.num_rows), batch.column("g").value_lengths().to_numpy(zero_copy_only=False))
            cells = np.bincount(row * 702 + g, n, batch.num_rows * 702).reshape(-1, 26, 27)
            one, two = cells.sum(axis=2), cells[:, :, :26]
            all_, total = one.sum(axis=1), two.sum(axis=(1, 2))
            h2 = (bits(two.sum(axis=2)) - bits(two.reshape(-1, 676))) / np.maximum(total, 1)
            yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(np.log2(all_) - bits(one) / all_), pa.array(h2)], names=[*keys, "h1", "h2"])

    rows = docs.select(*keys, "letters").mapInArrow(counted, f"{kinds}, g array<smallint>, n array<bigint>")
    by = rows.groupBy(*keys).agg(F.flatten(F.collect_list("g")).alias("g"), F.flatten(F.collect_list("n")).alias("n"))
    return by.mapInArrow(entropies, f"{kinds}, h1 double, h2 double")


def word_pairs(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, w1, w2, n): counts of neighbouring words within documents."""
    pairs = docs.select(*keys, F.explode(neighbours(F.col("toks"))).alias("b")).select(*keys, "b.*")
    return pairs.groupBy(*keys, "w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def word_conditional_entropy(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, h, pairs): entropy of a word given the word before it."""
    joint = pairs.groupBy(*keys).agg(bits("n").alias("hj"), F.sum("n").alias("pairs"))
    ctx = pairs.groupBy(*keys, "w1").agg(F.sum("n").alias("n")).groupBy(*keys).agg(bits("n").alias("hc"))
    return joint.join(ctx, list(keys)).select(*keys, (F.col("hj") - F.col("hc")).alias("h"), "pairs")


def word_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, tok, c)."""
    return docs.select(*keys, F.explode("toks").alias("tok")).groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("c"))


#: Ranks that are summed one by one; beyond them sums are given by a formula.
EXACT_RANKS = 255


def log_sums(low: Column, high: Column, power: int) -> Column:
    """The sum of ln(r) ** ``power`` (1 or 2) for r from ``low`` to ``high``, whatever their number.

    The first ranks one by one, the others by the formula of Euler and
    Maclaurin: the integral, half of both ends, and two corrections by derivatives. Its error is below 1e-12 there.
    """
    few = F.when(low <= EXACT_RANKS, F.sequence(low, F.least(high, F.lit(EXACT_RANKS).cast("long"))))
    head = F.coalesce(F.aggregate(few, F.lit(0.0), lambda s, r: s + F.pow(F.log(r.cast("double")), F.lit(float(power)))), F.lit(0.0))
    x, y = F.greatest(low, F.lit(EXACT_RANKS + 1).cast("long")).cast("double"), high.cast("double")
    log = F.log
    if power == 1:
        whole, value, first, third = (lambda r: r * log(r) - r), log, (lambda r: 1 / r), (lambda r: 2 / (r * r * r))
    else:
        whole, value = (lambda r: r * log(r) * log(r) - 2 * r * log(r) + 2 * r), (lambda r: log(r) * log(r))
        first, third = (lambda r: 2 * log(r) / r), (lambda r: (4 * log(r) - 6) / (r * r * r))
    tail = whole(y) - whole(x) + (value(x) + value(y)) / 2 + (first(y) - first(x)) / 12 - (third(y) - third(x)) / 720
    return head + F.when(y >= x, tail).otherwise(0.0)


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z >= 1, by Stirling's series ten places on."""
    w = z + 10
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w)
    return series - sum((F.log(z + k) for k in range(1, 10)), F.log(z))


def zipf(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, exponent, r2, types, total, ttr): least squares of ln frequency on ln rank.

    Equal frequencies take ranks in any order, which does not move the slope:
    so ranks need only the number of types by frequency, a table of a few
    thousand rows, not a sort of the vocabulary; the sums over the ranks of one frequency are in closed form.
    """
    by_freq = counts.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys).orderBy(F.desc("c"))
    ranked = by_freq.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.col("upto") - F.col("k") + 1, F.col("upto")
    rows = ranked.select(*keys, "c", "k", F.log(F.col("c") + F.lit(1e-10)).alias("y"), log_sums(low, high, 1).alias("x"), log_sums(low, high, 2).alias("xx"))
    total = lambda e: F.sum(e)
    sums = rows.groupBy(*keys).agg(
        total("k").cast("double").alias("n"), total("x").alias("x"), total("xx").alias("xx"), total(F.col("k") * F.col("y")).alias("y"), total(F.col("k") * F.col("y") * F.col("y")).alias("yy"),
        total(F.col("x") * F.col("y")).alias("xy"), F.sum("k").alias("types"), F.sum(F.col("c") * F.col("k")).alias("total"),
    )
    n = F.col("n")
    vx, vy, vxy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y"), n * F.col("xy") - F.col("x") * F.col("y")
    # one type has no slope; equal frequencies have a slope of zero, and all of nothing is explained
    flat = vy <= 1e-12 * n * n
    exponent = F.when(n > 1, F.when(flat, 0.0).otherwise(-vxy / vx))
    r2 = F.when(n > 1, F.when(flat, 1.0).otherwise(vxy * vxy / (vx * vy)))
    return sums.select(*keys, exponent.alias("exponent"), r2.alias("r2"), "types", "total", (F.col("types") / F.col("total")).alias("ttr"))


def top(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words, ties by the word: a bounded sort, n rows."""
    return counts.orderBy(F.desc("c"), "tok").limit(n)


def positions(counts: DataFrame) -> DataFrame:
    """(ch, initial, medial, final, singleton): where letters stand in words; ``counts`` has (tok, c)."""
    chars = counts.select("c", F.length("tok").alias("len"), F.posexplode(F.filter(F.split("tok", ""), lambda x: x != "")).alias("i", "ch"))
    kind = F.when(F.col("len") == 1, "singleton").when(F.col("i") == 0, "initial").when(F.col("i") == F.col("len") - 1, "final").otherwise("medial")
    one = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("c"))), F.lit(0)).alias(k)
    return chars.groupBy("ch").agg(one("initial"), one("medial"), one("final"), one("singleton"))


def glyph_classes(where: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(ch, class, confidence) from the shares of positions."""
    names = ("initial", "medial", "final", "singleton")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    share = {n: F.col(n) / total for n in names}
    ordered = F.sort_array(F.array(*share.values()), asc=False)
    cls = (
        F.when(share["initial"] >= threshold, "PREFIX").when(share["final"] >= threshold, "SUFFIX")
        .when(share["medial"] >= threshold, "MEDIAL").otherwise("ANY")
    )
    return where.select("ch", cls.alias("class"), (F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))).alias("confidence"))
