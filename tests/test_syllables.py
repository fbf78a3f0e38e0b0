"""The syllable beam against all paths, and transitions by hand."""

import math
import random
from itertools import product

import pytest

from stratalex.operators import syllables as sy


def case(seed):
    rng = random.Random(seed)
    syls = ["ka", "to", "e", "ri", "be"]
    after = {s: {t: rng.random() for t in rng.sample([*syls, sy.SPACE], 4)} for s in [*syls, sy.SPACE]}
    affixes = {"a": ["ka", "e"], "b": ["to"], "ab": ["ri", ""], "": ["", "be"]} if seed % 2 else {"a": ["ka", "ri"], "b": ["to", "e"]}
    return ["".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(5)], after, affixes


@pytest.mark.parametrize("seed", range(12))
def test_the_beam_finds_the_best_of_all_paths(seed):
    tokens, after, affixes = case(seed)
    best = {}
    for path in product(*(sy.candidates(t, affixes) for t in tokens)):
        last, score, text = sy.SPACE, 0.0, ""
        for s in path:
            score += math.log(after.get(last, {}).get(s, sy.UNSEEN))
            text += s + (" " if after.get(s, {}).get(sy.SPACE, sy.END) > sy.ENDS else "")
            last = s
        best.setdefault(round(score, 9), set()).add(text)
    text, score = sy.decode(tokens, after, affixes, width=1000)
    assert score == pytest.approx(max(best)) and text in best[max(best)]
    narrow = sy.decode(tokens, after, affixes, width=2)
    assert narrow[1] <= score + 1e-12 and narrow == sy.decode(tokens, after, affixes, width=2)


def test_candidates():
    assert sy.candidates("abc", {"a": ["x", "y"], "c": ["z"]}) == ["xz", "yz"]
    assert sy.candidates("a", {"a": ["x"]}) == ["ae"]  # the affixes would lie over each other
    assert sy.candidates("aa", {"a": ["x"]}) == ["xx"]
    assert sy.candidates("q", {}) == ["qe"]


def test_transitions_and_documents(spark):
    rows = spark.createDataFrame([("kato", 3, ["ka", "to"]), ("ka", 1, ["ka"]), ("", 5, [])], "word string, freq long, syls array<string>")
    got = {(r.s1, r.s2): r.p for r in sy.transitions(rows).collect()}
    assert got == {(sy.SPACE, "ka"): 1.0, ("ka", "to"): 0.75, ("ka", sy.SPACE): 0.25, ("to", sy.SPACE): 1.0}
    tokens, after, affixes = case(3)
    docs = spark.createDataFrame([(1, tokens), (2, []), (None, tokens * 300), (1, tokens)], "doc_id long, toks array<string>")
    out = sy.decode_documents(docs, after, affixes).collect()
    text, score = sy.decode(tokens, after, affixes)
    assert [(r.decoded, r.score) for r in out if r.doc_id == 1] == [(text, score)] * 2
    assert [(r.n, r.score, r.decoded) for r in out if r.doc_id == 2] == [(0, None, "")]
    assert [r.n for r in out if r.doc_id is None] == [1500]
