"""Word grammars: inside probabilities against sums over all parses, populations, generated words."""

from functools import lru_cache

import numpy as np
import pytest

from stratalex.operators import grammar as gr


def spend(rng):
    return {s: rng.random(26) for s in gr.SPENDERS}


def by_all_parses(g, word, depth=60):
    """Sum over all derivations by their definition; chains of single rules up to ``depth``."""
    total = {}
    for left, _, w in g.rules:
        total[left] = total.get(left, 0) + w

    @lru_cache(None)
    def sym(s, i, j, d):
        if d < 0:
            return 0.0
        out = 0.0
        if s in g.spend and j - i == 1:
            out += g.spend[s][ord(word[i]) - 97] / g.spend[s].sum()
        return out + sum(w / total[s] * seq(right, i, j, d - 1) for left, right, w in g.rules if left == s)

    @lru_cache(None)
    def seq(right, i, j, d):
        if len(right) == 1:
            return sym(right[0], i, j, d)
        return sum(sym(right[0], i, k, d if k - i > 0 else d) * seq(right[1:], k, j, d) for k in range(i + 1, j - len(right) + 2))

    return sym("W", 0, len(word), depth)


def grammars():
    rng = np.random.default_rng(0)
    yield gr.Grammar(list(gr.SHAPE), spend(rng))
    # a symbol of several kinds, a long rule that ends as another one, recursion and a cycle of single rules
    yield gr.Grammar([*gr.SHAPE, ("B", ("B", "M"), 0.3), ("W", ("M", "B", "S"), 0.2), ("P", ("M",), 0.5), ("B", ("C",), 0.4), ("C", ("B",), 0.3), ("C", ("M", "P", "M"), 0.7)], spend(rng))
    g = next(iter([gr.Grammar(list(gr.SHAPE), spend(rng))]))
    for _ in range(40):
        g = gr.changed(g, rng)
    yield g


def numbers(words):
    return np.array([[ord(c) - 97 for c in w] for w in words])


@pytest.mark.parametrize("which", range(3))
def test_inside_is_the_sum_over_all_parses(which):
    g = list(grammars())[which]
    for words in (["a", "z"], ["ab", "zz"], ["abc", "qqq"], ["abcd", "xyxy"], ["abcab", "aaaaa"]):
        got = gr.inside(g, numbers(words))
        assert got == pytest.approx([by_all_parses(g, w) for w in words], rel=1e-6, abs=1e-15)


def test_cost_counts_each_word():
    g = next(grammars())
    words, counts = ["a", "ab", "", "abc", "ab"], np.array([1, 2, 5, 3, 4.0])
    want = -sum(c * np.log2((1 - gr.ANY) * by_all_parses(g, w) + gr.ANY * 27.0 ** -(len(w) + 1)) for w, c in zip(words, counts) if w)
    assert gr.cost_of_words(g, words, counts) == pytest.approx(want)


def test_populations_get_better(spark):
    counts = spark.createDataFrame([("the", 9), ("then", 5), ("they", 3), ("tha", 2), ("a", 1), ("ne", 4)], "tok string, c long").repartition(3)
    best, history = gr.evolve(counts, islands=2, size=4, generations=6, migrate=2)
    assert len(best) == 2 and len(history) == 7
    assert all(b <= a + 1e-12 for a, b in zip(history, history[1:])) and history[-1] == min(c for _, c in best)
    words, c = ["the", "then", "they", "tha", "a", "ne"], np.array([9, 5, 3, 2, 1, 4.0])
    for g, bits in best:
        assert bits == pytest.approx(gr.cost_of_words(g, words, c) / sum(len(w) * k for w, k in zip(words, c)))
    assert gr.evolve(counts, islands=2, size=4, generations=6, migrate=2)[1] == history
    assert gr.judged(counts.limit(0), [best[0][0]]) == [float("inf")]


def test_spelled_words_have_the_grammar_s_probabilities(spark):
    rng = np.random.default_rng(1)
    g = gr.Grammar([("W", ("P",), 0.5), ("W", ("P", "S"), 0.5)], {"P": np.eye(26)[0] + np.eye(26)[1], "S": np.eye(26)[2], "M": np.ones(26)})
    words = [gr.spell(g, rng) for _ in range(4000)]
    for w in ("a", "b", "ac", "bc"):
        assert words.count(w) / 4000 == pytest.approx(by_all_parses(g, w), abs=0.04)
    docs = spark.createDataFrame([(1, 3), (2, 0), (None, 4), (1, 3)], "doc_id long, n int")
    rows = sorted(gr.spelled(docs, g, "n").collect())
    assert [len(r.text.split()) for r in rows] == [3, 3, 0] and rows[0] == rows[1]
