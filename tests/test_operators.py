"""Operators on small inputs: identities, bounds and hand-worked cases."""

import itertools
import math
import random
import time
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalex.operators import decode, graph, matching, nulls, rolling, search, stats
from stratalex.plans.models import draw
from stratalex.sources.tables import neighbours


def docs(spark, *texts):
    return spark.createDataFrame([(i, "x", "s", t.split()) for i, t in enumerate(texts)], "doc_id long, lang string, source string, toks array<string>")


def test_entropies_of_a_deterministic_text(spark):
    h = stats.char_entropies(stats.char_grams(docs(spark, "ababab abab"), "lang"), "lang").first()
    assert abs(h["h1"] - 1) < 1e-9 and abs(h["h2"]) < 1e-9 and abs(h["h3"]) < 1e-9


def test_char_grams_cross_words_of_one_letter(spark):
    g = {(r["p2"], r["p1"], r["ch"]): r["n"] for r in stats.char_grams(docs(spark, "a b cd"), "lang").collect()}
    assert g == {(None, None, "a"): 1, (None, "a", "b"): 1, ("a", "b", "c"): 1, ("b", "c", "d"): 1}


def test_neighbours(spark):
    rows = docs(spark, "a b c", "a", "").select("doc_id", F.explode(neighbours(F.col("toks"))).alias("p")).select("doc_id", "p.*").collect()
    assert sorted(map(tuple, rows)) == [(0, "a", "b"), (0, "b", "c")]


def test_zipf_of_equal_frequencies(spark):
    z = stats.zipf(spark.createDataFrame([("x", w, 2) for w in "abcd"], "lang string, tok string, c long"), "lang").first()
    assert abs(z["exponent"]) < 1e-9 and z["types"] == 4 and z["total"] == 8 and z["ttr"] == 0.5


def test_fuzzy_changes_one_segment_and_never_adds(spark):
    types = spark.createDataFrame([("t", "K-L-M-N-R")], "tok string, skel string")
    index = spark.createDataFrame([("K-L-M-N-S", "near", 1), ("K-L-M-N-R-S", "longer", 1), ("K-L-M-S-S", "far", 1)], "skel string, word string, freq long")
    assert [r["word"] for r in matching.fuzzy_matches(types, index).collect()] == ["near"]
    short = spark.createDataFrame([("t", "K-L")], "tok string, skel string")
    assert matching.fuzzy_matches(short, index).count() == 0


def test_nearest_resolved(spark):
    t = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "b", None), (1, 2, "c", None), (1, 3, "d", "d")], "doc_id long, pos long, tok string, word string")
    got = {r["pos"]: (r["left"], r["left_gap"], r["right"], r["right_gap"]) for r in matching.nearest_resolved(t).collect()}
    assert got[1] == ("a", 1, "d", 2) and got[2] == ("a", 2, "d", 1) and got[0] == (None, None, "d", 3)


def test_confidence_ladder(spark):
    df = spark.createDataFrame([(2, 2, True, False), (2, 2, True, True), (5, 9, False, False)], "s int, n int, d boolean, b boolean")
    got = [r[0] for r in df.select(matching.confidence_threshold(F.col("s"), F.col("n"), F.col("d"), F.col("b"))).collect()]
    assert [round(x, 6) for x in got] == [2.25, 1.5, 3.0]


def test_consensus(spark):
    r = spark.createDataFrame([("K", "x"), ("K", "x"), ("K", "y"), ("L", "z"), ("L", "z")], "skel string, word string")
    assert [(x["skel"], x["word"], x["c"], x["total"]) for x in matching.consensus(r).collect()] == [("K", "x", 2, 3)]
    assert [x["skel"] for x in matching.consensus(r, 2, 1.0).collect()] == ["L"]


def test_binomial_tail(spark):
    cases = [(0, 5, 0.5), (3, 5, 0.25), (5, 5, 0.5), (2, 40, 0.01), (1, 1, 1.0)]
    df = spark.createDataFrame(cases, "k long, m long, p double")
    got = [r[0] for r in df.select(matching.binomial_tail(F.col("k"), F.col("m"), F.col("p"))).collect()]
    want = [sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k, m + 1)) for k, m, p in cases]
    assert np.allclose(got, want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=18))
def test_components_match_union_find(spark, pairs):
    parent = list(range(15))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = graph.connected_components(spark.createDataFrame(pairs or [(0, 0)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in nodes}


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for _ in range(10):
        c = rng.random((5, 5))
        best = min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(5)))
        assert abs(c[np.arange(5), search.assign(c)].sum() - best) < 1e-9


def test_markov():
    m = search.markov(np.array([[0.5, 0.5], [0.5, 0.5]]))
    assert abs(m["entropy_rate"] - 1) < 1e-9 and m["irreversible"] < 1e-9


def test_branching_skeletons():
    assert decode.branching_skeletons("yk") == [("K", 0.7), ("J-K", 0.3)]
    assert decode.branching_skeletons("") == [] and decode.branching_skeletons("eee") == []


def test_budget_lowers_a_word_used_too_often():
    rows = decode.BudgetedDecoder([("K-L", "kal", 0.1)]).decode(["kol"] * 4)
    assert [r[1] for r in rows] == ["high", "open", "open", "open"]


def test_budgeted_rules_by_hand():
    words = [("K-L", "kal", 0.1), ("T", "et", 0.01), ("K-R-T-L-M", "kartelam", 0.001)]
    d = decode.BudgetedDecoder(words, {"y": "et"}, ({"k": ["k"]}, {"dy": ["al"]}))
    # one use is under 3 x max(0.5, 0.01 n); a second is too dense
    assert [r[1] for r in d.decode(["y", "y", "y"])] == ["function", "function", "dense"]
    # the prefix is stripped, so its sign is no segment; the suffix stands for another one
    assert d._strip("kkoldy") == ("k", "kol", "dy") and d._like("kal", "k", "dy") == 20
    assert d.decode(["kkoldy"])[0][:2] == ("kal", "high")
    assert d.decode(["kkol"])[0][1] == "medium" and d.decode(["kkol"])[0][3] == ["kal"]
    assert d.decode(["kol"], frozenset({"kal"}))[0][1] == "open"  # nothing but a vowel and a sign is left of the stem
    assert decode.BudgetedDecoder(words).decode(["kol"], frozenset({"kal"}))[0][2] > 50
    # five segments: one of them may differ
    assert d._words("K-R-T-L-N") == [("kartelam", 0.001)] and d._words("K-T") == []


def test_beam_prefers_known_trigrams():
    m = decode.TrigramModel([["a", "b", "c"], ["a", "b", "c"], ["a", "x", "y"]])
    words = {"1": ["a"], "2": ["b", "x"], "3": ["c", "y"]}
    path, _ = decode.beam(["1", "2", "3"], lambda a, b, t: sorted((-math.log(m.p(a, b, c)), c) for c in words[t]), 15)
    assert path == ["a", "b", "c"]


def test_a_wide_beam_finds_the_best_of_all_paths():
    rng = random.Random(4)
    word = lambda: rng.choice(["aab", "aac", "aad", "bba", "bbc", "cca"])
    m = decode.TrigramModel([[word() for _ in range(12)] for _ in range(6)])
    index = {"aa": ["aab", "aac", "aad"], "bb": ["bba", "bbc"]}
    ranked = decode.Ranker(m, index)
    for _ in range(20):
        tokens = [rng.choice(["aax", "bbx", "zz"]) for _ in range(6)]
        found = []
        for choice in itertools.product(*(index.get(t[:2], [t]) for t in tokens)):
            line = ["<s>", "<s>", *choice]
            found.append(sum(math.log(m.p(*line[i : i + 3])) for i in range(len(choice))))
        path, score = decode.beam(tokens, ranked, 10_000)
        line = ["<s>", "<s>", *path]
        assert abs(score - max(found)) < 1e-9 and abs(sum(math.log(m.p(*line[i : i + 3])) for i in range(len(path))) - score) < 1e-9
        assert decode.beam(tokens, ranked, 1)[1] <= score + 1e-12


def test_skeletons_match_all_choices():
    """Brute force: every way to sound or silence each y and o."""
    rng = random.Random(2)
    for _ in range(200):
        stem = "".join(rng.choice("aeoykdlrsht") for _ in range(rng.randint(1, 9)))
        parts, i = [], 0
        while i < len(stem):
            w = 2 if stem[i : i + 2] in decode.CIPHER_CLASSES and len(stem[i : i + 2]) == 2 else 1
            x = stem[i : i + w]
            if x in decode.CIPHER_CLASSES:
                parts.append([(decode.CIPHER_CLASSES[x], 1.0)])
            elif x in decode.SEMI and (i == 0 or (stem[i - 1] in "aeoy" and stem[i + 1 : i + 2] and stem[i + 1] in "aeoy")):
                parts.append([("", 0.7), (decode.SEMI[x], 0.3)])
            i += w
        want = {}
        for choice in itertools.product(*parts):
            made = [k for k, _ in itertools.groupby(c for c, _ in choice if c)]
            if made:
                key = "-".join(made)
                want[key] = max(want.get(key, 0), math.prod(p for _, p in choice))
        got = dict(decode.branching_skeletons(stem))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_long_runs_of_choices_are_no_product():
    began = time.time()
    got = decode.branching_skeletons("o" * 200)
    assert [k for k, _ in got] == ["P"] and abs(got[0][1] / (0.7**198 * 0.3) - 1) < 1e-9 and time.time() - began < 1
    assert len(decode.branching_skeletons("yo" * 20)) > 20
    # a dictionary bounds what is followed
    assert [k for k, _ in decode.branching_skeletons("aoak" * 60, {("K",), ("K", "P")})] == ["K"]


def test_permuted_pairs_match_brute_force():
    words = list("abcab")
    known = [("a", "b"), ("c", "a"), ("x", "y")]
    real, null = nulls.permuted_hits(words, known, 4000, [1], cells=64)
    every = [sum((a, b) in known for a, b in zip(p, p[1:])) for p in itertools.permutations(words)]
    assert real == 3 and abs(null.mean() - np.mean(every)) < 0.05 and abs((null >= real).mean() - np.mean(np.array(every) >= real)) < 0.03
    assert nulls.permuted_hits(words, [], 5, [1])[1].tolist() == [0] * 5
    again = nulls.permuted_hits(words, known, 50, [1], cells=1 << 20)[1]
    assert 0 <= again.min() and again.max() <= 4


def test_window_entropies():
    rows = np.array([[1, 1, 1, 1], [1, 2, 3, 4], [1, 1, 2, 2]])
    assert np.allclose(rolling.entropies(rows, 4), [0, 2, 1])


def test_fuzzy_matches_equal_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ktpslrmn") for _ in range(rng.randint(3, 7)))
    types, words = [(w, i) for i, w in enumerate({word() for _ in range(150)})], {word() for _ in range(150)}
    from stratalex.functions import text as ft

    t = spark.createDataFrame(types, "tok string, n int").withColumn("skel", ft.skeleton(F.col("tok")))
    index = matching.skeleton_index(spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, freq int"))
    got = {(r["tok"], r["word"]) for r in matching.fuzzy_matches(t.select("tok", "skel"), index).collect()}
    own, other = t.collect(), index.collect()
    equal = {r["skel"] for r in other}
    apart = t.select("tok", "skel").crossJoin(index.select(F.col("skel").alias("near"), "word")).where(F.levenshtein("skel", "near") <= 1).collect()
    want = {(r["tok"], r["word"]) for r in apart if r["skel"] not in equal and len(r["skel"].split("-")) > 4}
    assert got == want and len(own) > 100 and got


def test_draws_are_even(spark):
    n = spark.range(4000).select(draw(4, F.lit("x"), F.col("id")).alias("k")).groupBy("k").count().collect()
    assert sorted(r["k"] for r in n) == [0, 1, 2, 3] and all(850 < r["count"] < 1150 for r in n)


def test_rank_pairs_take_unused_words_first():
    rows = search.rank_pairs(["a", "b", "c"], ["x", "y", "z"], window=1, keep=2)
    assert [(w, o) for w, place, o, _, _ in rows if place == 1] == [("a", "x"), ("b", "y"), ("c", "z")]
    assert rows[0] == ("a", 1, "x", 0, "HIGH") and rows[1] == ("a", 2, "y", 1, "HIGH")
    late = search.rank_pairs(["a", "b"], ["x"], window=5, keep=5)
    assert late == [("a", 1, "x", 0, "HIGH"), ("b", 1, "x", 1, "MODERATE")]


def test_carried_bits_come_back():
    after = {"a": ["b", "c"], "b": ["a"], "c": ["a", "d"]}
    rng = random.Random(3)
    for _ in range(20):
        bits = [rng.randint(0, 1) for _ in range(40)]
        words = search.carry(bits, after, ["a", "c"])
        assert search.carried_bits(words, after)[: len(bits)] == bits


def test_greedy_sets_match_the_plain_loop(spark):
    rng = random.Random(5)
    labels = sorted({"".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(80)})
    mask = lambda w: sum(1 << k for k in {ord(c) - 97 for c in w})
    first = {}
    for w in labels:
        first.setdefault(mask(w), w)
    got = {r["mask"]: r["seed"] for r in search.greedy_sets(spark.createDataFrame([(k, v) for k, v in first.items()], "mask int, first string")).collect()}
    seeds, want = [], {}
    for m, _ in sorted(first.items(), key=lambda x: x[1]):
        hit = [s for s in seeds if 2 * (s & m).bit_count() > (s | m).bit_count()]
        want[m] = hit[0] if hit else m
        if not hit:
            seeds.append(m)
    assert got == want


def test_sums_of_logarithms_over_any_number_of_ranks(spark):

    cases = [(1, 1), (1, 255), (1, 256), (3, 900), (256, 256), (700, 699), (254, 5000), (300, 100_000)]
    df = spark.createDataFrame(cases, "a long, b long")
    for power in (1, 2):
        got = [r[0] for r in df.select(stats.log_sums(F.col("a"), F.col("b"), power)).collect()]
        for (a, b), x in zip(cases, got):
            assert x == pytest.approx(math.fsum(math.log(r) ** power for r in range(a, b + 1)), rel=1e-12, abs=1e-10)
    big = spark.createDataFrame([(1, 10**9)], "a long, b long").select(stats.log_sums(F.col("a"), F.col("b"), 1)).first()[0]
    assert big == pytest.approx(math.lgamma(10**9 + 1), rel=1e-12)
    z = spark.createDataFrame([(x,) for x in (1.0, 1.5, 2.0, 7.3, 100.0, 1e8)], "z double").select("z", stats.log_gamma(F.col("z"))).collect()
    assert [r[1] for r in z] == [pytest.approx(math.lgamma(r[0]), rel=1e-11, abs=1e-9) for r in z]


def test_zipf_of_ten_million_hapaxes(spark):
    """One frequency of 10^7 types, as counts of counts would give it: the slope equals that of all ranks."""
    few = [("x", c, 1) for c in (50, 20, 9, 4)]
    rows = spark.createDataFrame(few, "lang string, c long, k int").select("lang", F.lit("w").alias("tok"), "c").unionByName(spark.range(10**6).select(F.lit("x").alias("lang"), F.col("id").cast("string").alias("tok"), F.lit(1).cast("long").alias("c")))
    z = stats.zipf(rows, "lang").first()
    rank, c = np.arange(1, 10**6 + 5), np.concatenate([[50, 20, 9, 4], np.ones(10**6)])
    slope = np.polyfit(np.log(rank), np.log(c + 1e-10), 1)[0]
    assert z.exponent == pytest.approx(-slope, rel=1e-6) and z.types == 10**6 + 4 and z.total == 83 + 10**6
    low, high = F.lit(5).cast("long"), F.lit(10**7 + 4).cast("long")
    one = spark.range(1).select(stats.log_sums(low, high, 1), stats.log_sums(low, high, 2)).first()
    r = np.log(np.arange(5, 10**7 + 5))
    assert one[0] == pytest.approx(r.sum(), rel=1e-11) and one[1] == pytest.approx((r * r).sum(), rel=1e-11)


def test_binomial_tail_of_a_hundred_million(spark):

    def tail(k, m, p):
        """Sum of the terms that matter, from the largest on."""
        first = max(k, int(m * p))
        out = 0.0
        for step in (1, -1):
            i = first if step == 1 else first - 1
            while k <= i <= m:
                t = math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(p) + (m - i) * math.log1p(-p))
                out += t
                if t < 1e-18 * max(out, 1e-300) or abs(i - first) > 300_000:
                    break
                i += step
        return out

    cases = [(3, 10, 0.2), (0, 5, 0.5), (6, 5, 0.5), (5, 5, 0.5), (1, 10**8, 1e-9), (50_001_000, 10**8, 0.5), (49_990_000, 10**8, 0.5), (10_100_000, 10**8, 0.1), (200, 10**6, 1e-4), (5, 9, 0.0), (5, 9, 1.0)]
    df = spark.createDataFrame(cases, "k long, m long, p double")
    got = [r[0] for r in df.select(matching.binomial_tail(F.col("k"), F.col("m"), F.col("p"))).collect()]
    for (k, m, p), x in zip(cases, got):
        want = 1.0 if k <= 0 or p >= 1 else 0.0 if k > m or p <= 0 else tail(k, m, p)
        assert x == pytest.approx(want, rel=2e-5, abs=1e-12), (k, m, p)


def test_greedy_sets_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(search, "ROUND_SETS", 3)
    rng = random.Random(9)
    masks = sorted({sum(1 << k for k in rng.sample(range(26), rng.randint(1, 8))) for _ in range(200)})
    first = {m: "".join(rng.choices("abcdef", k=5)) for m in masks}
    got = {r["mask"]: r["seed"] for r in search.greedy_sets(spark.createDataFrame(list(first.items()), "mask int, first string").repartition(4)).collect()}
    seeds, want = [], {}
    for m, _ in sorted(first.items(), key=lambda x: (x[1], x[0])):
        hit = [s for s in seeds if 2 * (s & m).bit_count() > (s | m).bit_count()]
        want[m] = hit[0] if hit else m
        if not hit:
            seeds.append(m)
    assert got == want and len(seeds) > 20
    assert search.greedy_sets(spark.createDataFrame([], "mask int, first string")).count() == 0


def test_chained_texts(spark):
    after = {"a": (["b", "c"], [0.25, 1.0]), "b": (["a"], [1.0])}
    docs = spark.createDataFrame([(1, 4000), (2, 0), (None, 3), (1, 4000)], "doc_id long, n int")
    rows = sorted(search.chained(docs, after).collect())
    assert [len(r.text.split()) for r in rows] == [4000, 4000, 0] and rows[0] == rows[1]
    w = rows[0].text.split()
    nexts = [b for a, b in zip(w, w[1:]) if a == "a"]
    assert set(nexts) == {"b", "c"} and nexts.count("b") / len(nexts) == pytest.approx(0.25, abs=0.05)
    assert all(b == "a" for a, b in zip(w, w[1:]) if a == "b")
    assert search.chained(docs, {}).where("doc_id = 1").first().text == ""


def test_the_moving_grille_is_a_sequential_one(spark, tmp_path):
    from stratalex.plans import models

    rng = random.Random(4)
    texts = {i * 3000: " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 30))) for i in range(12)}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.words, r.text_md5) for r in models.moving_grille(spark, str(tmp_path)).collect()}
    count = {}
    for t in texts.values():
        for w in t.split():
            if len(w) > 1:
                count[w[:2]] = count.get(w[:2], 0) + 1
    cells = [p for p, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))][:144]
    cells = [cells[i % len(cells)] for i in range(144)]
    at = 0
    for i, t in sorted(texts.items()):
        out = []
        for w in t.split():
            n = 1 if len(w) <= 3 else 2 if len(w) <= 5 else 3 if len(w) <= 7 else 4
            word = "".join(cells[(h // 12 + at // 12) % 12 * 12 + (h % 12 + at) % 12] for h in models.HOLES[n])
            out.append(word[: len(w) + 1] if len(word) > len(w) + 2 else word)
            at += 1
        if out:
            import hashlib

            assert got.pop(i) == (len(out), hashlib.md5(" ".join(out).encode()).hexdigest())
    assert not got


def test_long_stems_are_followed_to_their_end():
    rng = random.Random(6)
    words = [("-".join(rng.choice("KTPSLRMN") for _ in range(n)), f"w{i}", 0.1) for i, n in enumerate((5, 6, 14, 16))]
    decoder = decode.BudgetedDecoder(words)
    signs = {"K": "k", "T": "t", "P": "p", "S": "s", "L": "l", "R": "r", "M": "m", "N": "n"}
    skels = [w[0].split("-") for w in words]
    for parts in skels:
        for k in range(0, len(parts), 3):
            changed = [*parts[:k], next(c for c in "KTPS" if c != parts[k] and c not in parts[max(0, k - 1) : k + 2]), *parts[k + 1 :]]
            if any(a == b for a, b in zip(changed, changed[1:])):
                continue
            ways = decode.branching_skeletons("e".join(c.lower() for c in changed), decoder.near)
            assert all(tuple(w.split("-")) in decoder.near for w, _ in ways)
    # a cut after 24 signs would lose the end of a long stem
    free = decode.branching_skeletons("k" + "eyek" * 9, decode.Near({tuple("K" * 1), *(tuple(("K", "J") * k + ("K",))[:j] for k in range(1, 10) for j in range(1, 2 * k + 2))}))
    assert max(len(w.split("-")) for w, _ in free) >= 19
