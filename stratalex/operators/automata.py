"""Automata as tables: prefix trees, merged and minimal states, partition refinement, depth and cycles.

An automaton is ``edges`` (g, s, c, t), deterministic in (s, c), and ``accepting`` (g, s),
for each group g; all groups are worked on at once. Loops write a table a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.session import Tables


def prefix_tree(words: DataFrame) -> DataFrame:
    """(g, s, depth, accepting, letters, tail) of ``words`` (g, tok), distinct: the states of the prefix tree.

    ``letters`` are those that lead on. ``tail`` stands for all endings that
    lead from the state to a word: two sums of hashes of the endings and their number, so it is made
    in one grouping, whatever the depth. States of equal tails are one state of the minimal automaton.
    """
    n = F.length("tok")
    cut = words.select("g", "tok", F.explode(F.sequence(F.lit(0), n)).alias("depth"))
    cut = cut.select("g", "depth", F.expr("left(tok, depth)").alias("s"), F.expr("substring(tok, depth + 1)").alias("rest"))
    tail = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rest")).alias("x"), F.bit_xor(F.xxhash64(F.lit("tail"), "rest")).alias("y"))
    states = cut.groupBy("g", "s", "depth").agg(F.max(F.col("rest") == "").alias("accepting"), F.sort_array(F.collect_set(F.when(F.col("rest") != "", F.left("rest", F.lit(1))))).alias("letters"), tail.alias("tail"))
    return states


def contexts(words: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The automaton whose states are the last ``order`` letters: (edges, accepting) of ``words`` (g, tok); ``^`` stands for no letter."""
    padded = F.concat(F.lit("^" * order), "tok")
    at = words.select("g", padded.alias("w"), F.explode(F.sequence(F.lit(1), F.length("tok"))).alias("i"))
    edges = at.select("g", F.expr(f"substring(w, i, {order})").alias("s"), F.expr(f"substring(w, i + {order}, 1)").alias("c"), F.expr(f"substring(w, i + 1, {order})").alias("t")).distinct()
    return edges, words.where(F.length("tok") > 0).select("g", F.right(padded, F.lit(order)).alias("s")).distinct()


def _states(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.explode(F.array("s", "t")).alias("s")).distinct()


def minimise(edges: DataFrame, accepting: DataFrame) -> DataFrame:
    """(g, s, class): states with equal endings have equal classes. Cycles are no hindrance.

    Partition refinement: a state's class is split by the classes its letters
    lead to, until a round makes no new one. A row a state and round; a state gathers as many cells as it has letters.
    """
    spark, tables, before = edges.sparkSession, Tables(edges.sparkSession), Tables(edges.sparkSession)
    edges = tables.put(edges, "edges")
    flag = accepting.distinct().withColumn("class", F.lit("1"))
    state = before.put(_states(edges).unionByName(accepting.select("g", "s")).distinct().join(flag, ["g", "s"], "left").select("g", "s", F.coalesce("class", F.lit("0")).alias("class")), "classes")
    size = state.select("g", "class").distinct().count()
    while True:
        to = edges.join(state.select("g", F.col("s").alias("t"), F.col("class").alias("to")), ["g", "t"]).groupBy("g", "s").agg(F.sort_array(F.collect_list(F.struct("c", "to"))).alias("out"))
        fresh = Tables(spark)
        told = F.md5(F.concat_ws("|", F.col("class"), F.coalesce(F.to_json("out"), F.lit(""))))
        state = fresh.put(state.join(to, ["g", "s"], "left").select("g", "s", told.alias("class")), "classes")
        before.drop()
        before, last, size = fresh, size, state.select("g", "class").distinct().count()
        if size == last:
            tables.drop()
            return state


def depths(edges: DataFrame, first: DataFrame) -> DataFrame:
    """(g, s, depth): the fewest letters from one of ``first`` (g, s) to each state that can be reached; a round a letter."""
    spark, tables = edges.sparkSession, Tables(edges.sparkSession)
    edges = tables.put(edges, "edges")
    seen = tables.put(first.distinct().withColumn("depth", F.lit(0)), "depths")
    front, depth = seen, 0
    while True:
        depth += 1
        new = edges.join(front.select("g", "s"), ["g", "s"]).select("g", F.col("t").alias("s")).distinct().join(seen, ["g", "s"], "left_anti")
        front = tables.put(new.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            result = Tables(spark).put(seen, "depths")
            tables.drop()
            return result
        seen = seen.unionByName(front)


def cyclic(edges: DataFrame) -> DataFrame:
    """(g): the groups with a cycle. States that lead nowhere go, round after round; what is left lies on cycles or leads to one."""
    before, spark = Tables(edges.sparkSession), edges.sparkSession
    left = before.put(edges.select("g", "s", "t").where("s <> t").distinct(), "left")
    loops = edges.where("s = t").select("g").distinct()
    size = left.count()
    while size:
        fresh = Tables(spark)
        left = fresh.put(left.join(left.select("g", F.col("s").alias("t")).distinct(), ["g", "t"], "left_semi").select("g", "s", "t"), "left")
        before.drop()
        before, last, size = fresh, size, left.count()
        if size == last:
            break
    return left.select("g").unionByName(loops).distinct()


def topology(edges: DataFrame, accepting: DataFrame, first: DataFrame) -> DataFrame:
    """(g, states, transitions, accepting, letters, branching, widest, depth, cycles, density) of each group's automaton."""
    out = edges.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.sum("n").alias("transitions"), F.avg("n").alias("branching"), F.max("n").alias("widest"))
    size = _states(edges).unionByName(accepting).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("states"))
    parts = [
        size, out, accepting.distinct().groupBy("g").agg(F.count(F.lit(1)).alias("accepting")), edges.groupBy("g").agg(F.count_distinct("c").alias("letters")),
        depths(edges, first).groupBy("g").agg(F.max("depth").alias("depth")), cyclic(edges).withColumn("cycles", F.lit(True)),
    ]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.join(p, "g", "left")
    all_ = all_.fillna({"transitions": 0, "branching": 0.0, "widest": 0, "accepting": 0, "letters": 0, "depth": 0, "cycles": False})
    return all_.withColumn("density", F.col("transitions") / F.greatest(F.lit(1), F.col("states") * F.col("letters")))


def likeness(signatures: DataFrame) -> DataFrame:
    """(a, b, likeness) of each two groups: one less the mean relative difference of states, branching, depth and density."""
    features = ("states", "branching", "depth", "density")
    a, b = (signatures.select(F.col("g").alias(k), *(F.col(f).alias(f"{f}_{k}") for f in features)) for k in "ab")
    gap = lambda f: F.abs(F.col(f"{f}_a") - F.col(f"{f}_b")) / F.greatest(F.abs(f"{f}_a"), F.abs(f"{f}_b"), F.lit(1.0))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (1 - sum(gap(f) for f in features) / len(features)).alias("likeness"))
