"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import splitmix, word_hashes, word_places

HASHES = 3
#: A paragraph ends after one word in so many, chosen by its hash, and in a word without end after one place in so many.
WORDS, PLACES = 8, 32
#: Longer words, in bytes, are cut inside.
LONG = 64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def paragraph_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(joined texts, begin and end of each paragraph there, text of each paragraph).

    A paragraph ends at a line end, after a word that ends in . ! ? or |, and
    after words whose hash is 0 modulo ``WORDS``; the white space after it
    belongs to it. Words of over ``LONG`` bytes also end one where the hash of
    the eight bytes before is 0 modulo ``PLACES``. Where a cut falls depends on
    what stands just before it alone, not on the length of the text, so an edit
    moves few cuts. An empty text has no paragraph.
    """
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    begins = ends - np.array([len(t) for t in texts], np.int64)
    start, end = word_places(data)
    cuts = [np.zeros(0, np.int64)]
    if len(start):
        # where a word's white space ends; the last word of a text ends with it
        after = np.minimum(np.append(start[1:], len(data)), ends[np.searchsorted(ends, start, "left")])
        lines = np.concatenate(([0], np.cumsum(raw == 10)))
        sign = raw[end - 1]
        cut = (word_hashes(data, start, end) % np.uint64(WORDS) == 0) | (lines[after] > lines[end])
        cut |= (sign == 46) | (sign == 33) | (sign == 63) | (sign == 124)
        cuts.append(after[cut])
        long = end - start > LONG
        if long.any():
            lanes = np.ndarray((max(1, len(data) - 7),), "<u8", data + bytes(8), strides=(1,))
            for a, b in zip(start[long].tolist(), end[long].tolist()):
                at = np.arange(a + 8, b)
                at = at[(splitmix(lanes[at - 8]) % np.uint64(PLACES) == 0) & (raw[at] & 0xC0 != 0x80)]
                cuts.append(at)
    cuts = np.concatenate(cuts)
    # a cut at the end of a text is none
    cuts = cuts[~np.isin(cuts, ends)]
    full = begins < ends
    first = np.sort(np.concatenate((begins[full], cuts)))
    text = np.searchsorted(ends, first, "left")
    last = np.append(first[1:], len(data))
    return data, first, np.minimum(last, ends[text]) if len(first) else last[:0], text


def digest_sets(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit digest of each paragraph of each text; the k-th copy of a paragraph has a digest of its own."""
    data, first, last, text = paragraph_places(texts)
    h = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first))
    order = np.lexsort((h, text))
    s, t = h[order], text[order]
    at = np.arange(len(s))
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    h[order] = np.where(copy > 0, splitmix(s + copy.astype(np.uint64) * ODD[0]), s)
    return np.split(h, np.searchsorted(text, np.arange(1, len(texts))))


def digests(text: str) -> np.ndarray:
    """The digests of one text."""
    return digest_sets([text.encode("utf-8", "surrogatepass")])[0]


class Sketches:
    """Tables of many sets at once: counts, xor of digests and xor of checks, ``cells`` in a row for each set."""

    def __init__(self, sets: list[np.ndarray], cells: int, seed: int = 0) -> None:
        self.n, self.cells, self.seed = len(sets), cells, seed
        self.count = np.zeros(self.n * cells, np.int64)
        self.key = np.zeros(self.n * cells, np.uint64)
        self.check = np.zeros(self.n * cells, np.uint64)
        if sets:
            self.add(np.repeat(np.arange(self.n), [len(s) for s in sets]), np.concatenate(sets), 1)

    def places(self, row: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The cells of digests: one in each third of its row."""
        part = self.cells // HASHES
        mixed = splitmix(key + np.uint64(self.seed))
        return np.concatenate([row * self.cells + k * part + ((mixed * ODD[k]) >> np.uint64(33)).astype(np.int64) % part for k in range(HASHES)])

    def add(self, row: np.ndarray, key: np.ndarray, sign) -> None:
        at = self.places(row, key)
        np.add.at(self.count, at, np.tile(np.broadcast_to(sign, len(key)), HASHES))
        np.bitwise_xor.at(self.key, at, np.tile(key, HASHES))
        np.bitwise_xor.at(self.check, at, np.tile(checks(key), HASHES))

    def minus(self, other: Sketches, mine: np.ndarray, theirs: np.ndarray) -> Sketches:
        """Differences of the rows ``mine`` and the rows ``theirs`` of ``other``."""
        out = Sketches([], self.cells, self.seed)
        out.n = len(mine)
        a = (mine[:, None] * self.cells + np.arange(self.cells)).ravel()
        b = (theirs[:, None] * self.cells + np.arange(self.cells)).ravel()
        out.count = self.count[a] - other.count[b]
        out.key = self.key[a] ^ other.key[b]
        out.check = self.check[a] ^ other.check[b]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of all differences that come out, and which rows came out whole. Empties the table."""
        rows, keys, signs = [], [], []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[self.check[at] == checks(self.key[at])]
            if not len(at):
                break
            row, key, sign = at // self.cells, self.key[at], self.count[at]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
            row, key, sign = row[new], key[new], sign[new]
            self.add(row, key, -sign)
            rows.append(row)
            keys.append(key)
            signs.append(sign)
        bad = np.zeros(self.n, bool)
        bad[np.unique(np.flatnonzero((self.count != 0) | (self.key != 0)) // self.cells)] = True
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), ~bad
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(signs), ~bad

    def texts(self, sizes: list[int]) -> list[str]:
        """Each row as hexadecimal text: the set's size, then counts, digests and checks of its cells."""
        count = self.count.astype("<u4").reshape(self.n, -1)
        key = self.key.astype("<u8").reshape(self.n, -1)
        check = self.check.astype("<u4").reshape(self.n, -1)
        return [f"{n:08x}" + (c.tobytes() + k.tobytes() + x.tobytes()).hex() for n, c, k, x in zip(sizes, count, key, check)]


def checks(key: np.ndarray) -> np.ndarray:
    return splitmix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(0xFFFFFFFF)


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int, base: tuple[Sketches, Sketches] | None = None) -> np.ndarray:
    """How many digests differ in each pair of sets, by subtracting and peeling their sketches.

    Pairs that do not peel whole are tried again with tables four times as
    large, and with other places; ``base`` has sketches of the first size.
    """
    n = len(left)
    out = np.full(n, -1, np.int64)
    open_ = np.arange(n)
    gap = np.array([abs(len(a) - len(b)) for a, b in zip(left, right)], np.int64)
    seed = 0
    while len(open_):
        # a table with fewer cells than the sets differ in size cannot peel
        try_ = open_[gap[open_] <= cells]
        if len(try_):
            if base is not None:
                diff = base[0].minus(base[1], try_, try_)
            else:
                a = Sketches([left[i] for i in try_], cells, seed)
                diff = a.minus(Sketches([right[i] for i in try_], cells, seed), np.arange(len(try_)), np.arange(len(try_)))
            row, _, _, whole = diff.peel()
            found = np.bincount(row, minlength=len(try_))
            out[try_[whole]] = found[whole]
        open_ = open_[out[open_] < 0]
        cells, seed, base = cells * 4, seed + 1, None
    return out


def likeness(a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Shared share of the digests of both sets, from sizes and the number that differ; two empty sets are alike."""
    both = a + b
    return np.where(both == 0, 1.0, (both - differ) / np.maximum(both + differ, 1))


def sketch(docs: DataFrame, cells: int = 18) -> DataFrame:
    """(doc_id, fingerprint) of whole texts, with no shuffle; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = digest_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])
            prints = Sketches(sets, cells).texts([len(s) for s in sets])
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_versions(docs: DataFrame, cells: int = 18) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text), of its edited version and how alike they and the next one are.

    The next row is that of the next smaller id; rows of one id go by the hash
    of their texts, a null id comes last, and after the last comes the first (a
    single row follows itself). Rows are dealt out in ranges of ids; the first
    row of a range also goes to the range before it, so one shuffle is enough.
    A null text is empty; other columns are not read.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(low))).withColumn("tie", F.xxhash64("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.col("k").cast("double").alias("k")).stat.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    bounds = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        # descending: the largest ids are range 0
        return pd.Series((len(bounds) - np.searchsorted(bounds, k.to_numpy().astype(np.float64), "right")).astype(np.int32))

    heads = rows.select("k", "tie").withColumn("r", range_of("k")).groupBy("r").agg(F.max(F.struct("k", "tie")).alias("m")).collect()
    heads = sorted((h["r"], h["m"]["k"], h["m"]["tie"]) for h in heads)  # one for each range
    before = {r: heads[i - 1][0] for i, (r, _, _) in enumerate(heads)}
    if not heads:
        before = {0: 0}
    table = spark.createDataFrame(
        [(r, k, t, before[r]) for r, k, t in heads], "r int, head_k long, head_tie long, before int"
    )
    dealt = rows.withColumn("r", range_of("k")).join(F.broadcast(table), "r")
    head = (F.col("k") == F.col("head_k")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct(F.col("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("r"), F.lit(True).alias("guest"))
    dealt = dealt.withColumn("to", F.explode(F.when(head, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "k", "tie", "to.r", "to.guest")
    dealt = dealt.repartition("r").sortWithinPartitions("r", "guest", F.desc("k"), F.desc("tie"))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        pairs: list[tuple[int, int]] = []  # places of a row and of its next one
        place: tuple[int, bool] | None = None  # range of the row before, and whether it is a guest
        size = 0

        def done() -> pa.RecordBatch:
            mine, after = (np.array(x, np.int64) for x in zip(*pairs))
            changed = [edited(texts[a], texts[b]) for a, b in pairs]
            sets = digest_sets([t.encode("utf-8", "surrogatepass") for t in texts])
            others = digest_sets([t.encode("utf-8", "surrogatepass") for t in changed])
            left, right = [sets[i] for i in mine], [sets[i] for i in after]
            a, b, c = Sketches(left, cells), Sketches(others, cells), Sketches(right, cells)
            n = [np.array([len(s) for s in x], np.int64) for x in (left, others, right)]
            near = likeness(n[0], n[1], differences(left, others, cells, (a, b)))
            following = likeness(n[0], n[2], differences(left, right, cells, (a, c)))
            sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
            cols = ([ids[i] for i in mine], [len(texts[i]) for i in mine], sha, a.texts(n[0].tolist()), b.texts(n[1].tolist()), near, following)
            return pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for r, is_guest, ident, text in zip(*(batch.column(x).to_pylist() for x in ("r", "guest", "doc_id", "text"))):
                ids.append(ident)
                texts.append(text)
                if place is not None and place == (r, False):
                    pairs.append((len(texts) - 2, len(texts) - 1))
                    size += len(texts[-2])
                place = (r, is_guest)
                if size > 2_000_000 or len(pairs) >= 2000:
                    yield done()
                    ids, texts, pairs, size = ids[-1:], texts[-1:], [], 0
        if pairs:
            yield done()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
