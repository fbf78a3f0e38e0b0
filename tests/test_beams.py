"""Beams whose work for a token was done anew for each path and each document."""

import itertools
import random

from stratalex.operators import decode, syllables


def test_ties_are_told_apart_without_going_back(monkeypatch):
    calls, real = [], syllables._endings
    monkeypatch.setattr(syllables, "_endings", lambda *a: calls.append(a) or real(*a))
    affixes = {"a": ["ka", "e"], "b": ["to", "ri"], "": ["", "k"]}
    tokens = ["".join(random.Random(1).choices("ab", k=3)) for _ in range(500)]
    text, _ = syllables.decode(tokens, {"ka": {"ka": 0.5}}, affixes)
    assert text and len(calls) < 50


def test_a_reader_gives_the_best_text_of_all():
    rng = random.Random(4)
    affixes = {"a": ["ka", "e"], "b": ["to", "ek"], "": ["", "k"]}
    for _ in range(20):
        names = ["ka", "e", "to", "ek", "kak", syllables.SPACE]
        after = {s: {t: rng.choice([0.1, 0.3]) for t in names if rng.random() < 0.4} for s in names}
        tokens = ["".join(rng.choices("ab", k=rng.randint(1, 2))) for _ in range(4)]
        reader = syllables.Reader(after, affixes)
        part = lambda x: x + (" " if after.get(x, {}).get(syllables.SPACE, syllables.END) > syllables.ENDS else "")
        ways = []
        for way in itertools.product(*(syllables.candidates(t, affixes) for t in tokens)):
            score = 0.0
            for a, b in zip((syllables.SPACE, *way), way):
                score += syllables.math.log(after.get(a, {}).get(b, syllables.UNSEEN))
            ways.append((-score, "".join(map(part, way))))
        assert all(len(syllables.candidates(t, affixes)) <= syllables.WIDTH for t in tokens)
        text, score = reader.read(tokens)
        assert (-score, text) == min(ways) and reader.read(tokens) == (text, score)


def test_few_states_are_the_best_ones_and_ties_go_by_text():
    """The kept states of a token, one by one, by their definition."""
    rng = random.Random(6)
    affixes = {"a": ["ka", "e", "o"], "b": ["to", "ri", "u"], "": ["", "k"]}
    after = {s: {t: rng.choice([0.1, 0.2]) for t in ("ka", "to", "e", "ok", "u") if rng.random() < 0.5} for s in ("ka", "to", "e", "ok", "u", "ri", "kak")}
    tokens = ["".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(60)]
    beam = {syllables.SPACE: (0.0, "")}
    for token in tokens:
        fresh = {}
        for cand in syllables.candidates(token, affixes):
            score, text = min((-(s + syllables.math.log(after.get(last, {}).get(cand, syllables.UNSEEN))), t) for last, (s, t) in beam.items())
            fresh[cand] = (-score, text + cand + (" " if after.get(cand, {}).get(syllables.SPACE, syllables.END) > syllables.ENDS else ""))
        beam = dict(sorted(fresh.items(), key=lambda x: (-x[1][0], x[1][1]))[:3])
    score, text = min((-s, t) for s, t in beam.values())
    assert syllables.decode(tokens, after, affixes, 3) == (text, -score)


def test_lists_of_two_words_before_are_made_once(monkeypatch):
    rng = random.Random(5)
    words = ["ab" + x + y for x in "abcdef" for y in "abcdef"]
    sentences = [rng.choices(words[:20], k=30) for _ in range(20)]
    ranked = decode.Ranker(decode.TrigramModel(sentences), {"ab": words}, 5)
    calls, real = [], decode.Ranker._among
    monkeypatch.setattr(decode.Ranker, "_among", staticmethod(lambda *a: calls.append(a) or real(*a)))
    first = decode.beam(["abz"] * 40, ranked, 5)
    made = len(calls)
    assert decode.beam(["abz"] * 40, ranked, 5) == first and made and len(calls) == made
    one = decode.Ranker(decode.TrigramModel(sentences), {"ab": words})
    assert decode.beam(["abz"] * 40, lambda a, b, t: one(a, b, t), 5) == first
