"""Texts decoded as a stream of syllables: a beam over the transitions of syllables, candidates by affixes.

The state runs on from token to token, so a document is one row and one run;
documents go in parallel. The transitions and affixes are reference tables of checked size.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The syllable before the first one, the chance of a pair that was never seen, of a word's end after an unknown syllable, and the chance above which a word ends.
SPACE, UNSEEN, END, ENDS = "<SPACE>", 1e-4, 0.2, 0.1
#: States that are kept after each token.
WIDTH = 15
#: Tokens, and pairs of lists of readings, that a task remembers.
MOST_HELD = 100_000


def candidates(token: str, affixes: dict[str, list[str]]) -> list[str]:
    """What a token may stand for: the readings of each affix that begins it with those of each that ends it; else its first letter and an e."""
    starts = [a for k in range(len(token) + 1) if (a := token[:k]) in affixes]
    ends = [a for k in range(len(token) + 1) if (a := token[len(token) - k :]) in affixes]
    found = {x + y for a in starts for b in ends if len(token) >= len(a) + len(b) for x in affixes[a] for y in affixes[b]}
    return sorted(found) or [token[:1] + "e"]


class Reader:
    """Reads texts; what a token stands for, and which pairs of two tokens' readings are known, is found once for all texts of a task."""

    def __init__(self, after: dict[str, dict[str, float]], affixes: dict[str, list[str]], width: int = WIDTH) -> None:
        self.after, self.affixes, self.width = after, affixes, width
        #: Lists of readings by number, and how each reading is written.
        self.lists: list[list[str]] = [[SPACE]]
        self.parts: list[list[str]] = [[""]]
        self.number: dict[tuple[str, ...], int] = {(SPACE,): 0}
        self.of: dict[str, int] = {}
        self.known: dict[tuple[int, int], list[list[tuple[int, float]]]] = {}

    def _list(self, token: str) -> int:
        if len(self.of) > MOST_HELD:
            self.of.clear()
        own = candidates(token, self.affixes)
        k = self.number.setdefault(tuple(own), len(self.lists))
        if k == len(self.lists):
            self.lists.append(own)
            self.parts.append([x + (" " if self.after.get(x, {}).get(SPACE, END) > ENDS else "") for x in own])
        self.of[token] = k
        return k

    def _pairs(self, a: int, b: int) -> list[list[tuple[int, float]]]:
        """For each reading of list ``b`` those of list ``a`` that are known before it, by place, with their log odds."""
        if len(self.known) > MOST_HELD:
            self.known.clear()
        rows = [self.after.get(x, {}) for x in self.lists[a]]
        self.known[a, b] = [[(i, math.log(row[x])) for i, row in enumerate(rows) if x in row] for x in self.lists[b]]
        return self.known[a, b]

    def read(self, tokens: list[str]) -> tuple[str, float]:
        unseen, width = math.log(UNSEEN), self.width
        # of each reading of the token before: score, links back, and its text from some common beginning on, which tells equal ones apart
        before, scores, backs, tails, room = 0, [0.0], [None], [""], 256
        for token in tokens:
            now = self.of.get(token)
            if now is None:
                now = self._list(token)
            pairs = self.known.get((before, now)) or self._pairs(before, now)
            plain = [x + unseen for x in scores]
            best_plain, first = max(plain), -1
            fresh, links, texts = [], [], []
            for hits, part in zip(pairs, self.parts[now]):
                if hits:
                    all_ = plain[:]
                    for i, odds in hits:
                        all_[i] = scores[i] + odds
                    best = max(all_)
                    win = all_.index(best) if all_.count(best) == 1 else min((i for i, x in enumerate(all_) if x == best), key=tails.__getitem__)
                else:
                    # what is never seen after any of them follows the same one
                    if first < 0:
                        first = plain.index(best_plain) if plain.count(best_plain) == 1 else min((i for i, x in enumerate(plain) if x == best_plain), key=tails.__getitem__)
                    best, win = best_plain, first
                fresh.append(best)
                links.append((backs[win], part))
                texts.append(tails[win] + part)
            if len(fresh) > width:
                edge = sorted(fresh, reverse=True)[width - 1]
                # what is equal to the last one that stays is put in order by its text
                ties = sorted((i for i, x in enumerate(fresh) if x == edge), key=texts.__getitem__)
                for i in [i for i, x in enumerate(fresh) if x < edge] + ties[width - sum(x > edge for x in fresh) :]:
                    fresh[i], links[i], texts[i] = -math.inf, None, ""
            before, scores, backs, tails = now, fresh, links, texts
            if len(max(tails, key=len)) > room:
                kept = [i for i, x in enumerate(scores) if x > -math.inf]
                for i, text in zip(kept, _endings([backs[i] for i in kept])):
                    tails[i] = text
                room = 256 + 2 * len(max(tails, key=len))
        best = max(scores)
        win = min((i for i, x in enumerate(scores) if x == best), key=tails.__getitem__)
        return _spelled(backs[win]), best


def decode(tokens: list[str], after: dict[str, dict[str, float]], affixes: dict[str, list[str]], width: int = WIDTH) -> tuple[str, float]:
    """The text of the likeliest way through the candidates and its log probability; ties by the text.

    States that stand at one syllable go on alike, so of these only the best can win: a beam of
    as many states as there are candidates of a token is exact. Texts are kept as links, not copied.
    """
    return Reader(after, affixes, width).read(tokens)


def _endings(backs: list[tuple | None]) -> list[str]:
    """The texts of states of one token from where they part: in the order of the whole texts, but no longer than they differ."""
    out: list[list[str]] = [[] for _ in backs]
    while any(x is not backs[0] for x in backs):
        for k, x in enumerate(backs):
            out[k].append(x[1])
        backs = [x[0] for x in backs]
    return ["".join(reversed(x)) for x in out]


def _spelled(back: tuple | None) -> str:
    out = []
    while back:
        back, part = back
        out.append(part)
    return "".join(reversed(out))


def transitions(syllables: DataFrame) -> DataFrame:
    """(s1, s2, p) of ``syllables`` (word, freq, syls array): from the space to a word's first syllable, on to the next, and from the last to the space."""
    ring = F.concat(F.array(F.lit(SPACE)), F.col("syls"), F.array(F.lit(SPACE)))
    pairs = syllables.where(F.size("syls") > 0).select("freq", F.explode(F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("s1"), F.slice(ring, 2, F.size(ring) - 1).alias("s2"))).alias("x"))
    n = pairs.groupBy("x.s1", "x.s2").agg(F.sum("freq").alias("n"))
    total = n.groupBy("s1").agg(F.sum("n").alias("all"))
    return n.join(total, "s1").select("s1", "s2", (F.col("n") / F.col("all")).alias("p"))


def decode_documents(docs: DataFrame, after: dict[str, dict[str, float]], affixes: dict[str, list[str]], width: int = WIDTH) -> DataFrame:
    """(doc_id, n, score, decoded) of whole ``docs`` (doc_id, toks); no tokens give an empty text and no score."""
    held = docs.sparkSession.sparkContext.broadcast((after, affixes))

    def run(frames):
        reader = Reader(*held.value, width)
        for f in frames:
            rows = []
            for ident, toks in zip(f["doc_id"], f["toks"]):
                text, score = reader.read(list(toks)) if len(toks) else ("", None)
                rows.append((ident, len(toks), score, text))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "score", "decoded"])

    return docs.select("doc_id", "toks").mapInPandas(run, "doc_id long, n long, score double, decoded string")
