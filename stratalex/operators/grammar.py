"""Grammars of words: inside probabilities by a chart, and populations on islands that are judged by all words.

A grammar has rules over symbols, and letters for the symbols that spend one.
The probability of a word is the sum over all its parses. A generation is one
job: each task sums, for every grammar of all islands, what its words cost.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.operators.stats import positions

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A word is a body with perhaps a beginning and an end; a body is one to four letters or other symbols.
START = "W"
SHAPE = (("W", ("P", "B", "S"), 0.4), ("W", ("B", "S"), 0.3), ("W", ("P", "B"), 0.2), ("W", ("B",), 0.1), ("B", ("M",), 0.2), ("B", ("M", "M"), 0.35), ("B", ("M", "M", "M"), 0.3), ("B", ("M", "M", "M", "M"), 0.15))
SPENDERS = ("P", "M", "S")
MOST_RULES, LONGEST_RULE = 24, 4
#: Share of a word's probability that any letters have, so that no word is impossible; longer words than these have nothing else.
ANY, PARSED = 1e-3, 64


@dataclass
class Grammar:
    """rules: symbol, what it becomes, weight. spend: the symbols that are a letter, each with 26 weights."""

    rules: list[tuple[str, tuple[str, ...], float]]
    spend: dict[str, np.ndarray] = field(default_factory=dict)

    def compiled(self) -> tuple[list[str], list[tuple[int, int, int, float]], np.ndarray, np.ndarray]:
        """Symbols; rules of two symbols; closure of the rules of one symbol; letter probabilities of each symbol."""
        total: dict[str, float] = {}
        for left, _, weight in self.rules:
            total[left] = total.get(left, 0.0) + weight
        names = {n: i for i, n in enumerate(dict.fromkeys([START, *self.spend, *(s for left, right, _ in self.rules for s in (left, *right))]))}
        pairs, single = [], []
        for left, right, weight in self.rules:
            p, at = weight / total[left], names[left]
            # longer rules become pairs through symbols of their own
            while len(right) > 2:
                rest = names.setdefault("+".join(right[1:]), len(names))
                pairs.append((at, names[right[0]], rest, p))
                p, at, right = 1.0, rest, right[1:]
            if len(right) == 2:
                pairs.append((at, names[right[0]], names[right[1]], p))
            else:
                single.append((at, names[right[0]], p))
        # what is left of a long rule is the same symbol wherever it stands
        fixed, seen = {i for n, i in names.items() if "+" in n}, set()
        pairs = [x for x in pairs if x[0] not in fixed or not (x[:3] in seen or seen.add(x[:3]))]
        n = len(names)
        unit, letter = np.zeros((n, n)), np.zeros((n, 26))
        for a, b, p in single:
            unit[a, b] += p
        for s, weights in self.spend.items():
            letter[names[s]] = np.asarray(weights, float) / max(np.sum(weights), 1e-300)
        # chains of single rules in any number: a geometric series; a symbol that only becomes itself is nothing
        closure = np.linalg.solve(np.eye(n) - unit * (1 - 1e-9), np.eye(n))
        return list(names), pairs, closure, letter


def inside(grammar: Grammar, words: np.ndarray) -> np.ndarray:
    """Probability of each word of one length (rows of letter numbers) from the start symbol, over all parses."""
    names, pairs, closure, letter = grammar.compiled()
    count, size = words.shape
    if not size:
        return np.zeros(count)
    # which symbols stand side by side in a rule, and what each such couple gives to every symbol
    couples = sorted({(b, c) for _, b, c, _ in pairs})
    gives = np.zeros((len(couples), len(names)))
    for a, b, c, p in pairs:
        gives[couples.index((b, c)), a] += p
    gives = gives @ closure.T
    first, second = [b for b, _ in couples], [c for _, c in couples]
    # spans by length and beginning: the symbols of a couple on either side, (words, couples), and the whole at the end
    whole = {(1, i): letter[:, words[:, i]].T @ closure.T for i in range(size)}
    left, right = ({k: x[:, at] for k, x in whole.items()} for at in (first, second))
    for length in range(2, size + 1):
        for i in range(size - length + 1):
            both = left[1, i] * right[length - 1, i + 1]
            for k in range(2, length):
                both += left[k, i] * right[length - k, i + k]
            found = both @ gives
            if length == size:
                return found[:, names.index(START)]
            left[length, i], right[length, i] = found[:, first], found[:, second]
    return whole[1, 0][:, names.index(START)]


def cost_of_words(grammar: Grammar, words: list[str], counts: np.ndarray) -> float:
    """Bits that the words take, each as often as it is there. Any letters have a small share; a chart grows with the square of a word, so words of over ``PARSED`` letters have that share alone."""
    lengths = np.array([len(w) for w in words])
    long = lengths > PARSED
    bits = -float((counts[long] * (np.log2(ANY) - (lengths[long] + 1) * np.log2(27.0))).sum())
    for size in np.unique(lengths[(lengths > 0) & ~long]).tolist():
        at = np.flatnonzero(lengths == size)
        for part in np.array_split(at, max(1, len(at) * size * size // 2_000_000)):
            rows = np.frombuffer("".join(words[i] for i in part).encode(), np.uint8).reshape(len(part), size).astype(int) - 97
            p = (1 - ANY) * inside(grammar, rows) + ANY * 27.0 ** -(size + 1)
            bits -= float((counts[part] * np.log2(np.maximum(p, 1e-300))).sum())
    return bits


def changed(g: Grammar, rng: np.random.Generator) -> Grammar:
    """A grammar with one change: a weight, letters of a symbol, a new rule, one rule less, or another symbol in a rule."""
    rules, spend = list(g.rules), {s: w.copy() for s, w in g.spend.items()}
    symbols = sorted({*spend, *(left for left, _, _ in rules)})
    lefts = sorted({left for left, _, _ in rules})
    kind, at = rng.choice(["weight", "weight", "letters", "letters", "add", "drop", "swap"]), int(rng.integers(len(rules)))
    if kind == "weight":
        left, right, w = rules[at]
        rules[at] = (left, right, max(0.01, w * float(np.exp(rng.normal(0, 0.5)))))
    elif kind == "letters":
        s = symbols[int(rng.integers(len(symbols)))]
        if s in spend:
            spend[s] = np.maximum(spend[s] * np.exp(rng.normal(0, 0.3, 26)), 1e-4)
    elif kind == "add" and len(rules) < MOST_RULES:
        right = tuple(symbols[int(k)] for k in rng.integers(0, len(symbols), int(rng.integers(1, LONGEST_RULE))) if symbols[int(k)] != START)
        left = lefts[int(rng.integers(len(lefts)))]
        if right and right != (left,):
            rules.append((left, right, float(rng.random())))
    elif kind == "drop" and len(rules) > 5:
        left = rules[at][0]
        if sum(r[0] == left for r in rules) > 1:
            rules.pop(at)
    elif kind == "swap":
        left, right, w = rules[at]
        k, s = int(rng.integers(len(right))), symbols[int(rng.integers(len(symbols)))]
        new = (*right[:k], s, *right[k + 1 :])
        if s != START and new != (left,):
            rules[at] = (left, new, w)
    return Grammar(rules, spend)


def first_grammar(counts: DataFrame, rng: np.random.Generator, noise: float) -> Grammar:
    """The common shape, with the letters that begin, fill and end words in ``counts`` (tok, c): 26 rows at most."""
    where = {r["ch"]: r for r in positions(counts).collect()}
    rows = {"P": "initial", "M": "medial", "S": "final"}
    spend = {s: np.array([(where[x][k] if x in where else 0) + 1.0 for x in LETTERS]) for s, k in rows.items()}
    spend = {s: w / w.sum() * np.exp(rng.normal(0, noise, 26)) for s, w in spend.items()}
    return Grammar([(a, b, w * float(np.exp(rng.normal(0, noise)))) for a, b, w in SHAPE], spend)


def judged(counts: DataFrame, grammars: list[Grammar]) -> list[float]:
    """Bits a letter that each grammar needs for ``counts`` (tok, c); one row a grammar and task is all that moves."""
    held = counts.sparkSession.sparkContext.broadcast(grammars)

    def run(frames):
        bits = np.zeros(len(held.value))
        letters = 0.0
        for f in frames:
            words, c = f["tok"].tolist(), f["c"].to_numpy(float)
            letters += float((f["tok"].str.len().to_numpy() * c).sum())
            for i, g in enumerate(held.value):
                bits[i] += cost_of_words(g, words, c)
        yield pd.DataFrame({"i": np.arange(len(bits)), "bits": bits, "letters": letters})

    rows = counts.select("tok", "c").mapInPandas(run, "i long, bits double, letters double").groupBy("i").agg((F.sum("bits") / F.sum("letters")).alias("b")).collect()
    found = {r["i"]: r["b"] for r in rows}
    return [found.get(i) if found.get(i) is not None else float("inf") for i in range(len(grammars))]


def evolve(counts: DataFrame, islands: int = 3, size: int = 4, generations: int = 8, migrate: int = 3, seed: int = 42) -> tuple[list[tuple[Grammar, float]], list[float]]:
    """The best grammar of each island with its bits a letter, and the best of all after each generation.

    The better half of an island lives on, the rest are changed ones of it. Every
    ``migrate`` generations each island sends its best to the next one.
    """
    rngs = [np.random.default_rng([seed, i]) for i in range(islands)]
    herd = [[first_grammar(counts, rng, 0.0 if k == 0 else 0.4) for k in range(size)] for rng in rngs]
    cost: dict[int, float] = {}
    history = []
    for generation in range(generations + 1):
        new = [g for h in herd for g in h if id(g) not in cost]
        cost |= dict(zip(map(id, new), judged(counts, new))) if new else {}
        for h in herd:
            h.sort(key=lambda g: cost[id(g)])
        history.append(min(cost[id(h[0])] for h in herd))
        if generation == generations:
            break
        best = [h[0] for h in herd]
        for i, (h, rng) in enumerate(zip(herd, rngs)):
            kept = h[: max(1, size // 2)]
            if generation % migrate == migrate - 1 and islands > 1:
                kept = [*kept, best[i - 1]]
            h[:] = kept + [changed(kept[int(rng.integers(len(kept)))], rng) for _ in range(max(0, size - len(kept)))]
        alive = {id(g) for h in herd for g in h}
        cost = {k: v for k, v in cost.items() if k in alive}
    return [(h[0], cost[id(h[0])]) for h in herd], history


def speller(grammar: Grammar, longest: int = 200):
    """A function that makes a word of the grammar by numbers from 0 below 1, one a choice; a word that grows beyond ``longest`` symbols is cut there."""

    def shares(w):
        upto = (w / w.sum()).cumsum()
        return (upto / upto[-1]).tolist()

    by, letters = {}, {s: shares(w) for s, w in grammar.spend.items()}
    for left in {r[0] for r in grammar.rules}:
        own = [(right[::-1], w) for a, right, w in grammar.rules if a == left]
        by[left] = ([right for right, _ in own], shares(np.array([w for _, w in own])))

    def word(draw) -> str:
        todo, out = [START], []
        for _ in range(longest):
            if not todo:
                break
            s = todo.pop()
            if s in by:
                rights, upto = by[s]
                todo += rights[bisect_right(upto, draw())]
            elif s in letters:
                out.append(LETTERS[bisect_right(letters[s], draw())])
        return "".join(out)

    return word


def spell(grammar: Grammar, rng: np.random.Generator, longest: int = 200) -> str:
    """A word of the grammar by ``rng``."""
    return speller(grammar, longest)(rng.random)


def drawn(rng: np.random.Generator, at_once: int = 4096):
    """The numbers that ``rng`` gives one after the other, made many at once."""
    while True:
        yield from rng.random(at_once).tolist()


def spelled(docs: DataFrame, grammar: Grammar, size: str, seed: int = 1) -> DataFrame:
    """(doc_id, text): as many words of the grammar as ``size`` says for each of ``docs`` (doc_id, size), drawn from the id alone."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(frames):
        word = speller(held.value)
        for f in frames:
            texts = []
            for ident, n in zip(f["doc_id"], f["n"]):
                draw = drawn(np.random.default_rng([seed, int(ident) % 2**63]), min(4096, 8 * int(n) + 1)).__next__
                texts.append(" ".join([word(draw) for _ in range(int(n))]))
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": texts})

    return docs.where("doc_id is not null").select("doc_id", F.col(size).alias("n")).mapInPandas(run, "doc_id long, text string")
