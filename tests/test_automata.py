"""Automata as tables, against automata made on the driver."""

import random

from stratalex.operators import automata


def minimal_states(words: list[str]) -> tuple[int, int]:
    """(states of the trie, states after merging those with equal right languages) of an acyclic automaton."""
    trie: list[dict[str, int]] = [{}]
    final: list[bool] = [False]
    for w in words:
        s = 0
        for ch in w:
            if ch not in trie[s]:
                trie[s][ch] = len(trie)
                trie.append({})
                final.append(False)
            s = trie[s][ch]
        final[s] = True
    cls: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    for s in range(len(trie) - 1, -1, -1):  # children come after their parents
        key = (final[s], tuple(sorted((ch, cls[t]) for ch, t in trie[s].items())))
        cls[s] = seen.setdefault(key, len(seen))
    return len(trie), len(seen)


def test_the_plain_one():
    assert minimal_states(["ab", "cb"]) == (5, 3)


def vocabulary(seed, n):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(n)})


def frame(spark, groups):
    return spark.createDataFrame([(g, w) for g, ws in groups.items() for w in ws], "g string, tok string")


def test_tails_give_the_minimal_automaton(spark):
    groups = {"x": vocabulary(1, 150), "y": ["ab", "cb"], "z": [""], "w": ["a" * 40]}
    states = automata.prefix_tree(frame(spark, groups)).collect()
    for g, words in groups.items():
        own = [r for r in states if r.g == g]
        assert (len(own), len({tuple(r.tail) for r in own})) == minimal_states(words)
        assert {r.s for r in own if r.accepting} == set(words)
        assert all(r.letters == sorted({w[len(r.s)] for w in words if w.startswith(r.s) and len(w) > len(r.s)}) for r in own)


def random_automaton(rng, n, cyclic=True):
    edges = {(s, c): rng.randrange(n) if cyclic else rng.randrange(s + 1, n) for s in range(n if cyclic else n - 1) for c in "ab" if rng.random() < 0.7}
    return edges, {s for s in range(n) if rng.random() < 0.4} | {n - 1}


def equal_endings(edges, accepting, n):
    """Pairs of states that some word tells apart, by marking."""
    apart = {(s, t) for s in range(n) for t in range(n) if (s in accepting) != (t in accepting)}
    # a missing edge leads to a state that accepts nothing
    step = lambda s, c: edges.get((s, c), -1)
    alive = set(accepting)
    while more := {s for (s, c), t in edges.items() if t in alive} - alive:
        alive |= more
    while True:
        more = set()
        for s in range(n):
            for t in range(n):
                for c in "ab":
                    x, y = step(s, c), step(t, c)
                    if (x < 0) != (y < 0) or (x >= 0 and (x, y) in apart):
                        more.add((s, t))
        if more <= apart:
            return apart
        apart |= more


def test_refinement_with_cycles(spark):
    rng = random.Random(3)
    rows, ends, wants = [], [], {}
    for g in range(6):
        n = rng.randint(2, 12)
        edges, accepting = random_automaton(rng, n, cyclic=g % 2 == 0)
        rows += [(str(g), str(s), c, str(t)) for (s, c), t in edges.items()]
        ends += [(str(g), str(s)) for s in accepting]
        wants[str(g)] = (edges, accepting, n)
    e, a = spark.createDataFrame(rows, "g string, s string, c string, t string"), spark.createDataFrame(ends, "g string, s string")
    found = {}
    for r in automata.minimise(e, a).collect():
        found.setdefault(r.g, {})[int(r.s)] = r["class"]
    for g, (edges, accepting, n) in wants.items():
        apart = equal_endings(edges, accepting, n)
        for s, x in found[g].items():
            for t, y in found[g].items():
                assert (x != y) == ((s, t) in apart), (g, s, t)
    first = spark.createDataFrame([(g, "0") for g in wants], "g string, s string")
    sig = {r.g: r for r in automata.topology(e, a, first).collect()}
    for g, (edges, accepting, n) in wants.items():
        depth, front = {0: 0}, [0]
        while front:
            front = [t for s in front for c in "ab" if (t := edges.get((s, c))) is not None and t not in depth and not depth.update({t: depth[s] + 1})]
        reach = {s: {t for (x, c), t in edges.items() if x == s} for s in range(n)}
        for _ in range(n):
            reach = {s: r.union(*(reach[t] for t in r)) if r else r for s, r in reach.items()}
        assert sig[g].depth == max(depth.values()) and sig[g].cycles == any(s in r for s, r in reach.items())
        assert sig[g].transitions == len(edges) and sig[g].accepting == len(accepting)


def test_contexts_and_likeness(spark):
    words = frame(spark, {"x": ["ab", "abab"], "y": ["ab", "abab"], "z": ["c"]})
    edges, accepting = automata.contexts(words, 1)
    assert {tuple(r) for r in edges.where("g = 'x'").collect()} == {("x", "^", "a", "a"), ("x", "a", "b", "b"), ("x", "b", "a", "a")}
    assert {tuple(r) for r in accepting.where("g <> 'y'").collect()} == {("x", "b"), ("z", "c")}
    first = edges.select("g").distinct().selectExpr("g", "'^' as s")
    sig = automata.topology(edges, accepting, first)
    got = {(r.a, r.b): r.likeness for r in automata.likeness(sig).collect()}
    assert got["x", "y"] == 1.0 and 0 < got["x", "z"] < 1
