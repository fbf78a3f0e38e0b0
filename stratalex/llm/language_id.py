"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import chunks

BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
_LETTER: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Flags of the code points that are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0][codes]


def subwords(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) arrays of the subwords of whole texts, one pair for each order: n-grams of letters with one mark for a word's edge."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    letter = letters(codes)
    codes = np.where(letter, codes, 0).astype(np.uint32) * np.uint32(0x9E3779B1)
    out = []
    h = np.full(len(codes), 0x811C9DC5, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ codes[n - 1 :]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if n == 1:
            ok = letter
        elif n == 2:
            ok = letter[:-1] | letter[1:]
        else:
            ok = letter[1 : m + 1]
            for k in range(2, n - 1):
                ok = ok & letter[k : m + k]
        at = np.flatnonzero(ok)
        out.append((owner[at], (h[at] >> np.uint32(5)) & np.uint32(BUCKETS - 1)))
    return out


#: Longer texts are cut.
LONG = 300_000


def cut_long(text: str) -> list[str]:
    """A text in pieces of at most ``LONG`` characters, cut at spaces, which no subword spans (or anywhere, where there is none)."""
    out, at = [], 0
    while len(text) - at > LONG:
        to = text.rfind(" ", at + 1, at + LONG)
        out.append(text[at : to if to > 0 else at + LONG])
        at = to if to > 0 else at + LONG
    return [*out, text[at:]] if out else [text]


@dataclass(frozen=True)
class Model:
    """``table``: what each bucket adds to the logits (embedding times output weights), ``bias``, and the calibration."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and how many subwords it has; texts are taken in pieces of about 300,000 characters."""
        split = [(row, piece) for row, text in enumerate(texts) for piece in cut_long(text)]
        if len(split) > len(texts):
            rows, texts, n = np.array([r for r, _ in split]), [p for _, p in split], len(texts)
            sums, counts = self._sums(texts)
            whole, total = np.zeros((n, len(self.langs))), np.zeros(n, np.int64)
            np.add.at(whole, rows, sums)
            np.add.at(total, rows, counts)
        else:
            whole, total = self._sums(texts)
        return whole / np.maximum(total, 1)[:, None] + self.bias, total

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(texts), len(self.langs)))
        counts = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size == 0 or size + len(texts[to]) < 300_000):
                size += len(texts[to])
                to += 1
            for own, bucket in subwords(texts[at:to]):
                n = np.bincount(own, minlength=to - at)
                full = np.flatnonzero(n)
                if len(full) and self.langs:
                    starts = (np.cumsum(n) - n)[full]
                    out[at + full] += np.add.reduceat(self.table[bucket], starts, axis=0, dtype=np.float64)
                counts[at:to] += n
            at = to
        return out, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language or ``und``, probability) of each text; ``und`` where it has no letter."""
        z, n = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1) if len(self.langs) else np.zeros(len(texts), np.int64)
        lang = [self.langs[b] if k and self.langs else "und" for b, k in zip(best, n)]
        return lang, np.where(n > 0, p.max(axis=1) if len(self.langs) else 0.0, 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
    return z / z.sum(axis=1, keepdims=True) if z.shape[1] else z


def train(samples: list[tuple[str, str]], epochs: int = 5, rate: float = 0.5, scale: float = 20.0, seed: int = 7) -> Model:
    """Fit on (language, text) samples. A fifth is held back to fit the temperature and the rejection threshold.

    ``scale`` multiplies the averaged embedding. The threshold rejects one in a
    thousand of the held-back texts at most, and never a text whose probability
    is over one half.
    """
    rng = np.random.default_rng(seed)
    samples = [s for s in samples if s[0] is not None and any(map(str.isalpha, s[1] or ""))]
    langs = tuple(sorted({s[0] for s in samples}))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    order = rng.permutation(len(samples))
    back, use = order[: len(samples) // 5], order[len(samples) // 5 :]
    rows = []
    for lang, text in samples:
        b = np.concatenate([bucket for _, bucket in subwords([text])])
        u, c = np.unique(b, return_counts=True)
        rows.append((langs.index(lang), u, (c / c.sum()).astype(np.float32)))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    step, steps = 0, epochs * max(1, -(-len(use) // 16))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(use), max(1, -(-len(use) // 16))):
            if not len(batch):
                continue
            y = np.array([rows[i][0] for i in batch])
            idx = np.concatenate([rows[i][1] for i in batch])
            wt = np.concatenate([rows[i][2] for i in batch])
            sizes = np.array([len(rows[i][1]) for i in batch])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            hidden = np.add.reduceat(emb[idx] * wt[:, None], starts, axis=0) * scale
            grad = softmax(hidden @ out + bias)
            grad[np.arange(len(y)), y] -= 1
            now = rate * (1 - step / steps)
            back_grad = grad @ out.T
            out -= now * hidden.T @ grad / len(y)
            bias -= now * grad.mean(axis=0)
            np.subtract.at(emb, idx, now * scale / len(y) * np.repeat(back_grad, sizes, axis=0) * wt[:, None])
            step += 1
    table = (emb @ out) * np.float32(scale)
    model = Model(langs, table, bias.astype(np.float64), 1.0, 0.0)
    if not len(back):
        return model
    z, _ = model.logits([samples[i][1] for i in back])
    y = np.array([rows[i][0] for i in back])
    grid = np.geomspace(0.02, 5, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(z / temperature).max(axis=1)
    return Model(langs, table, model.bias, temperature, float(min(0.5, np.quantile(sure, 0.001))))


def held_out(ident: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_language: int = 400, windows: int = 3, window_words: int = 150, seed: int = 7, languages: int = 200) -> Model:
    """Train on a bounded sample of ``docs`` (doc_id, text, lang) outside the held-out third.

    The bound: the ``languages`` most frequent values of lang, about
    ``per_language`` documents of each, chosen by a hash of the id, and of each
    ``windows`` runs of words (a short, a middle and a long one of up to
    ``window_words``) from hashed places of the whole text. Repeated rows count
    once.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).where(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in counts.collect()}
    if not share:
        return train([])
    # one row for each of the languages at most
    shares = docs.sparkSession.createDataFrame(sorted(share.items()), "lang string, share double")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                words = text.split()
                rng = np.random.default_rng(abs(d or 0) + seed)
                for k, size in enumerate([window_words, window_words // 5, 6][:windows]):
                    at = int(rng.integers(0, max(1, len(words) - size + 1)))
                    out.append((d, k, lang, " ".join(words[at : at + size])))
            cols = zip(*out) if out else ((),) * 4
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "k", "lang", "text"])

    found = chosen.mapInArrow(cut, "doc_id long, k int, lang string, text string").distinct().collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["k"], r["lang"], r["text"]))
    return train([(r["lang"], r["text"]) for r in found])


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "_language") -> DataFrame:
    """``docs`` with the struct ``into`` (lang, score, rejected); all other columns stay, and none may have that name.

    Only the text is an input. Whole texts are read, a very long one piece by
    piece, with no shuffle; repeated rows are predicted alike. A null text or one
    without a letter is ``und`` with score 0, and rejected; others are rejected
    where the calibrated probability is under the threshold. An empty table
    gives none.
    """
    if into in docs.columns:
        raise ValueError(f"{into} is a column already; name another")
    names = docs.columns
    flat = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        named = (pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        for batch in chunks(named, text, 8 << 20):
            lang, score = own.predict([t or "" for t in batch.column(text).to_pylist()])
            bad = [name == "und" or s < own.reject_below for name, s in zip(lang, score)]
            extra = pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())],
                names=["lang", "score", "rejected"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, extra], names=[*names, into])

    # numbered columns, as a name may hold any sign
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return numbered.mapInArrow(run, f"{flat}, `{into}` struct<lang: string, score: double, rejected: boolean>")
