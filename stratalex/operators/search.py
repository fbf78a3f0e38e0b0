"""Small dense problems: matrices of an alphabet or of a few hundred words, whose size no input changes."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (square matrix), by shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0] = i
        j, least, prev, done = 0, np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            done[j] = True
            open_ = np.flatnonzero(~done[1:]) + 1
            now = cost[row_of[j] - 1, open_ - 1] - u[row_of[j]] - v[open_]
            better = now < least[open_]
            least[open_[better]], prev[open_[better]] = now[better], j
            nxt = open_[np.argmin(least[open_])]
            delta = least[nxt]
            u[row_of[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j = nxt
            if not row_of[j]:
                break
        while j:
            row_of[j], j = row_of[prev[j]], prev[j]
    out = np.zeros(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def markov(p: np.ndarray) -> dict[str, float]:
    """Stationary entropy rate, second eigenvalue, mixing time and departure from reversibility of a chain."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    pi = np.full(len(p), 1 / len(p))
    for _ in range(2000):
        pi = pi @ p
        pi /= pi.sum()
    rate = -float((pi[:, None] * p * np.log2(np.where(p > 0, p, 1))).sum())
    second = sorted(np.abs(np.linalg.eigvals(p)), reverse=True)[1]
    flow = pi[:, None] * p
    return {"entropy_rate": rate, "second": float(second), "mixing": float(-1 / np.log(max(min(second, 1 - 1e-12), 1e-12))), "irreversible": float(np.abs(flow - flow.T).sum() / 2)}


def chained(docs: DataFrame, after: dict[str, tuple[list[str], list[float]]], seed: int = 1) -> DataFrame:
    """(doc_id, text): a text of ``n`` words for each of ``docs`` (doc_id, n), drawn one after the other by ``after`` (next words, shares up to each); a word without a next one starts anew.

    Draws follow from the id alone. The table of next words is a reference of checked size.
    """
    held = docs.sparkSession.sparkContext.broadcast((after, sorted(after)))

    def run(frames):
        table, names = held.value
        for f in frames:
            texts = []
            for ident, n in zip(f["doc_id"], f["n"]):
                luck = np.random.default_rng([seed, int(ident) % 2**63]).random(int(n) + 1).tolist() if names else []
                out, last = [], None
                for u in luck[: int(n)]:
                    nexts = table.get(last)
                    last = nexts[0][min(bisect_right(nexts[1], u), len(nexts[0]) - 1)] if nexts else names[int(u * len(names))]
                    out.append(last)
                texts.append(" ".join(out))
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": texts})

    return docs.where("doc_id is not null").select("doc_id", "n").mapInPandas(run, "doc_id long, text string")


#: Letter sets that a round decides one by one, and seeds that tasks may hold.
ROUND_SETS, MOST_SEEDS = 4096, 1_000_000


def _seed_of(masks: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Place of the first of ``seeds`` with which each set shares over half of both, or -1."""
    out = np.full(len(masks), -1, np.int64)
    for at in range(0, len(masks), 1024):
        part = masks[at : at + 1024, None]
        hit = 2 * np.bitwise_count(part & seeds[None]).astype(np.int64) > np.bitwise_count(part | seeds[None])
        out[at : at + 1024] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if len(seeds) else -1
    return out


def greedy_sets(first: DataFrame) -> DataFrame:
    """(mask, seed) of ``first`` (mask int of 26 bits, first): in the order of ``first``, a set joins the earliest seed it shares over half with, else it is a seed.

    In rounds. The first open sets, a bounded number, are decided in order; then all tasks
    drop the sets that one of the seeds takes. Later seeds come after them in the order, so what is
    dropped is decided for good. Seeds lie far apart, so rounds are few.
    """
    from stratalex.session import Tables

    spark, before = first.sparkSession, Tables(first.sparkSession)
    open_ = all_ = before.put(first.select("mask", "first"), "sets")
    keep = before
    seeds = np.zeros(0, np.int64)
    while True:
        head = np.array([r["mask"] for r in open_.orderBy("first", "mask").limit(ROUND_SETS).collect()], np.int64)
        if not len(head):
            break
        for mask in head.tolist():
            if _seed_of(np.array([mask]), seeds)[0] < 0:
                seeds = np.append(seeds, mask)
        if len(seeds) > MOST_SEEDS:
            raise ValueError(f"more than {MOST_SEEDS} clusters of letter sets")
        fresh = Tables(spark)
        open_ = fresh.put(open_.mapInPandas(_kept(spark.sparkContext.broadcast(seeds), False), "mask int, first string"), "sets")
        if before is not keep:
            before.drop()
        before = fresh
    result = Tables(spark).put(all_.mapInPandas(_kept(spark.sparkContext.broadcast(seeds), True), "mask int, seed int"), "seeds")
    before.drop()
    keep.drop()
    return result


def _kept(held, which: bool):
    """The sets that no seed takes, or each set with the seed that takes it."""

    def run(frames):
        for f in frames:
            at = _seed_of(f["mask"].to_numpy(np.int64), held.value)
            yield pd.DataFrame({"mask": f["mask"], "seed": held.value[at].astype(np.int32)}) if which else f[at < 0]

    return run


def rank_pairs(words: list[str], others: list[str], window: int, keep: int) -> list[tuple[str, int, str, int, str]]:
    """(word, place, other, gap, confidence) for each of ``words`` in order of rank: others within ``window`` ranks, those that were no word's first choice first."""
    used: set[str] = set()
    out = []
    for r, word in enumerate(words):
        near = [(others[k] in used, abs(r - k), k) for k in range(max(0, r - window), min(len(others), r + window + 1))]
        best = sorted(near)[:keep]
        if not best:
            continue
        used.add(others[best[0][2]])
        sure = "HIGH" if best[0][1] == 0 else "MODERATE" if best[0][1] <= 2 else "LOW"
        out += [(word, place, others[k], gap, sure) for place, (_, gap, k) in enumerate(best, 1)]
    return out


#: Words without a choice that follow each other before a text goes on elsewhere.
NO_CHOICE = 64


def carry(bits: list[int], after: dict[str, list[str]], start: list[str]) -> list[str]:
    """A text whose choices between two next words spell ``bits``; where a word has no next one, or none has a choice for long, the text goes on with a word of ``start`` in turn, each of which has one."""
    out, at, turn, idle = [start[0]], 0, 1, 0
    while at < len(bits):
        nexts = after.get(out[-1], [])
        if len(nexts) > 1:
            out.append(nexts[bits[at]])
            at, idle = at + 1, 0
        elif nexts and idle < NO_CHOICE:
            out.append(nexts[0])
            idle += 1
        else:
            out.append(start[turn % len(start)])
            turn, idle = turn + 1, 0
    return out


def carried_bits(words: list[str], after: dict[str, list[str]]) -> list[int]:
    """The choices of a text."""
    return [after[a].index(b) for a, b in zip(words, words[1:]) if len(after.get(a, [])) > 1]


class Carrier:
    """Messages written as ``carry`` does and read back, a letter at a time: what a letter becomes after a word is found and read back once."""

    def __init__(self, after: dict[str, list[str]]) -> None:
        self.after = after
        self.start = sorted(w for w, n in after.items() if len(n) > 1)
        self.parts: dict[tuple[str, str], tuple[int, int, str]] = {}
        self.steps: dict[tuple[str, str], tuple[int, str | None, int, bool]] = {}

    def _step(self, word: str, bits: str) -> tuple[int, str | None, int, bool]:
        """From ``word`` to the end of ``bits``, or to where the text has to go on elsewhere: words, the last one (null there), bits that are left, and whether what was written is read back."""
        out, at, idle = [word], 0, 0
        while at < len(bits):
            nexts = self.after.get(out[-1], [])
            if len(nexts) > 1:
                out.append(nexts[int(bits[at])])
                at, idle = at + 1, 0
            elif nexts and idle < NO_CHOICE:
                out.append(nexts[0])
                idle += 1
            else:
                break
        same = carried_bits(out, self.after) == [int(b) for b in bits[:at]]
        return len(out) - 1, out[-1] if at == len(bits) else None, len(bits) - at, same

    def write(self, message: str, ident: int) -> tuple[int, int, bool]:
        """Bits of the message, words of its text, and whether reading it back gives the same."""
        if not self.start or not message:
            return 0, int(bool(self.start)), True
        first, parts, steps = self.start, self.parts, self.steps
        turn, word, count, same, size = ident, first[ident % len(first)], 1, True, 0
        for c in message:
            found = parts.get((word, c))
            if found:
                bits, more, word = found
                size, count = size + bits, count + more
                continue
            bits, begin, whole = f"{ord(c):08b}", (word, c, count), True
            size, wide = size + len(bits), len(bits)
            while bits:
                step = steps.get((word, bits))
                if step is None:
                    step = steps[word, bits] = self._step(word, bits)
                more, word, left, good = step
                count, same, bits = count + more, same and good, bits[len(bits) - left :]
                if word is None:
                    # the next word of ``start`` in turn, which no table holds
                    turn, whole = turn + 1, False
                    word, count = first[turn % len(first)], count + 1
            if whole and same:
                parts[begin[:2]] = wide, count - begin[2], word
        return size, count, same


def carried(docs, after: dict[str, list[str]]):
    """(doc_id, bits, words, same) of ``docs`` (doc_id, message): messages written as texts and read back."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(after)

    def run(batches):
        carrier = Carrier(held.value)
        for batch in batches:
            rows = [(i, *carrier.write(m, i or 0)) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("message").to_pylist())]
            cols = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "bits", "words", "same"])

    return docs.select("doc_id", "message").mapInArrow(run, "doc_id long, bits long, words long, same boolean")
