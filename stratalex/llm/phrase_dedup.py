"""Substring dedup by repeated-phrase automata.

1. Whole rows travel once, in blocks of a few MB. Each block gives the distinct
   anchors of its windows (the seven-word gram of least hash in each window of 13
   words), with the smallest and largest document that holds them. Equal windows
   have equal anchors, so a window that recurs has an anchor that recurs.
2. Blocks meet the anchors that recur in two documents and give the windows
   around them; windows that start in a smaller document are confirmed by hash.
3. Of each run of confirmed windows a block asks for those that cover its words,
   and the block of the first document sends their words.
4. Each block compiles the words it was sent into Aho-Corasick automata and
   streams all its documents through them. The automata compare words, so what
   has only an equal hash stays. Words under an occurrence of a window with a
   smaller document go.

Spans are added up by task before they are shuffled, so a passage that a third
of all documents share is one row for each block and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import LANES, Tables, blob_to_table, checkpointed, chunks, materialize, pack_blocks, splitmix, word_hashes, word_places

WINDOW, GRAM = 13, 7
#: Phrases compiled into one automaton at a time.
SHARD_PHRASES = 10_000
#: A word is so many characters of so many values each, other ones for each place, as a state looks through its next characters one by one.
PLACES, VALUES = 3, 64


class Words:
    """The words of the texts of a block: places in the joined bytes, document of each, and hash of each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts)
        self.start, self.end = word_places(self.data)
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: First word of each text, and one past the last.
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = word_hashes(self.data, self.start, self.end)

    def grams(self, size: int) -> np.ndarray:
        """Hash of ``size`` words from each place on (places near the end are short of words and left out)."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.hash[:n].copy()
        for k in range(1, size):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + self.hash[k : k + n]
        return splitmix(out)

    def whole(self) -> np.ndarray:
        """Places of the windows that lie within one text."""
        n = len(self.hash) - WINDOW + 1
        return np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows that lie within one text, and the place of each one's anchor."""
        n, whole = len(self.hash) - WINDOW + 1, self.whole()
        if not len(whole):
            return whole, whole
        grams = self.grams(GRAM)
        anchor = sliding_window_view(grams, WINDOW - GRAM + 1)[:n].argmin(axis=1)
        return whole, whole + anchor[whole]


def _spans(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the smallest and the largest document of each."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    if not len(hashes):
        return hashes, docs, docs
    at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[at], np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)


def _read(blob: bytes, ident: str, text: str) -> tuple[pa.Table, Words, np.ndarray, np.ndarray]:
    table = blob_to_table(blob)
    ids = table.column(ident).combine_chunks()
    known = np.asarray(ids.is_valid())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    texts = [t or b"" for t in table.column(text).cast(pa.binary()).to_pylist()]
    return table, Words(texts), ids, known


def _rows(names: list[str], *cols: np.ndarray) -> pa.Table:
    return pa.table([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols], names=names)


def _hits(words: Words, ids: np.ndarray, known: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of known documents that are among the sorted ``windows``, and the index of each there."""
    places = words.whole()
    places = places[known[words.doc[places]]]
    hashes = words.grams(WINDOW)[places]
    near = np.minimum(np.searchsorted(windows, hashes), len(windows) - 1)
    hit = windows[near] == hashes
    return places[hit], near[hit]


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", block_bytes: int = 2 << 20, into: str = "_dedup") -> DataFrame:
    """All rows and columns of ``docs``, with ``kept_text``, ``n_words`` and ``n_removed`` in the struct ``into``.

    A window is 13 words in a row of one document; a word goes if a window that
    covers it also starts in a document with a smaller id. Kept words keep the
    white space before them. A null text has no words and stays null; a null id
    is compared with none; rows with equal ids never clean each other; a text of
    any length is one row of its block. ``into`` must be no column of ``docs``.
    An empty table gives none.
    """
    if into in docs.columns:
        raise ValueError(f"{into} is a column already; name another")
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    plain = docs.withColumn(ident, F.col(f"`{ident}`").cast("long"))
    blocks = checkpointed(pack_blocks(plain, block_bytes, level=6).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                _, words, ids, known = _read(blob.as_py(), ident, text)
                places, at = words.windows()
                at = np.unique(at[known[words.doc[places]]])
                h, lo, hi = _spans(words.grams(GRAM)[at], ids[words.doc[at]])
                yield from _rows(["block", "gram", "lo", "span"], np.full(len(h), block), h, lo, hi - lo).to_batches()

    # one row a gram, dealt evenly by its hash: small enough to build on without sorting the rows
    # ``lo`` is the block's smallest document with the key and ``span`` the way to its largest, mostly 0, which packs small
    rows = tables.put(blocks.mapInArrow(anchors, "block long, gram long, lo long, span long"), "phrase-anchors")
    spans = rows.groupBy("gram").agg(F.min("lo").alias("first"), F.max(F.col("lo") + F.col("span")).alias("last")).where("first < last")
    recurring = Tables(spark)
    grams = recurring.put(rows.select("block", "gram").join(spans.hint("shuffle_hash"), "gram", "left_semi"), "phrase-recurring")
    tables.drop()

    def windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["block", "window", "lo", "span"]
        if not right.num_rows:
            return _rows(names, *(np.zeros(0, np.int64),) * 4)
        _, words, ids, known = _read(left.column("blob")[0].as_py(), ident, text)
        places, at = words.windows()
        known_grams = np.sort(right.column("gram").to_numpy().view(np.uint64))
        grams = words.grams(GRAM)[at]
        near = np.minimum(np.searchsorted(known_grams, grams), len(known_grams) - 1)
        places = places[(known_grams[near] == grams) & known[words.doc[places]]]
        h, lo, hi = _spans(words.grams(WINDOW)[places], ids[words.doc[places]])
        return _rows(names, np.full(len(h), key[0].as_py()), h, lo, hi - lo)

    found = blocks.groupBy("block").cogroup(grams.groupBy("block"))
    found = tables.put(found.applyInArrow(windows, "block long, window long, lo long, span long"), "phrase-windows")
    recurring.drop()
    spans = found.groupBy("window").agg(F.min("lo").alias("first"), F.max(F.col("lo") + F.col("span")).alias("last")).where("first < last").drop("last")
    confirmed = Tables(spark)
    both = found.join(spans.hint("shuffle_hash"), "window").select("block", "window", "first", (F.col("lo") == F.col("first")).alias("owns"), (F.col("lo") + F.col("span") > F.col("first")).alias("later"))
    both = confirmed.put(both, "phrase-confirmed")
    tables.drop()

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["block", "window", "first"]
        if not right.num_rows:
            return _rows(names, *(np.zeros(0, np.int64),) * 3)
        _, words, ids, known = _read(left.column("blob")[0].as_py(), ident, text)
        order = np.argsort(right.column("window").to_numpy().view(np.uint64))
        own, first = (right.column(c).to_numpy()[order] for c in ("window", "first"))
        places, near = _hits(words, ids, known, own.view(np.uint64))
        mine = first[near] < ids[words.doc[places]]
        places, near = places[mine], near[mine]
        # of each run of windows the first, each 13th after it and the last cover the same words
        lone = np.diff(places, prepend=-2) != 1
        run = np.maximum.accumulate(np.where(lone, np.arange(len(places)), 0))
        take = ((np.arange(len(places)) - run) % WINDOW == 0) | np.append(lone[1:], True)[: len(places)]
        near = np.unique(near[take])
        return _rows(names, np.full(len(near), key[0].as_py()), own[near], first[near])

    later = both.where("later").select("block", "window", "first")
    asked = tables.put(blocks.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(ask, "block long, window long, first long"), "phrase-asked")
    # the block that holds the first document; of several (equal ids) any one
    owned = both.where("owns").select("window", "block").join(asked.select("window", "first").distinct(), "window")
    wanted = tables.put(owned.groupBy("window").agg(F.min("block").alias("block"), F.min("first").alias("first")), "phrase-wanted")
    confirmed.drop()

    def tell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        said, which = [], np.zeros(0, np.int64)
        if right.num_rows and left.num_rows:
            _, words, ids, known = _read(left.column("blob")[0].as_py(), ident, text)
            order = np.argsort(right.column("window").to_numpy().view(np.uint64))
            own, first = (right.column(c).to_numpy()[order] for c in ("window", "first"))
            places, near = _hits(words, ids, known, own.view(np.uint64))
            mine = first[near] == ids[words.doc[places]]
            near, at = np.unique(near[mine], return_index=True)
            which, places = own[near], places[mine][at]
            said = [b" ".join(words.data[a:b] for a, b in zip(words.start[p : p + WINDOW].tolist(), words.end[p : p + WINDOW].tolist())) for p in places.tolist()]
        return pa.table({"window": pa.array(which, pa.int64()), "words": pa.array(said, pa.binary())})

    told = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(tell, "window long, words binary")
    phrases, _ = materialize(asked.join(told, "window").select("block", "first", "words"), "phrase-words")
    tables.drop()

    flat = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in plain.schema)
    schema = f"{flat}, `{into}` struct<kept_text: string, n_words: bigint, n_removed: bigint>"

    def clean(key, left: pa.Table, right: pa.Table) -> pa.Table:
        table, words, ids, known = _read(left.column("blob")[0].as_py(), ident, text)
        gone = np.zeros(len(words.hash), bool)
        if right.num_rows:
            gone = occurrences(words, ids, known, right.column("words").to_pylist(), right.column("first").to_pylist())
        kept, n_words, n_removed = [], [], []
        blank = table.column(text).combine_chunks().is_null().to_pylist()
        for d, null in enumerate(blank):
            a, b = int(words.first[d]), int(words.first[d + 1])
            cut = int(gone[a:b].sum())
            n_words.append(b - a)
            n_removed.append(cut)
            if null:
                kept.append(None)
            elif not cut:
                kept.append(words.data[words.offsets[d] : words.offsets[d + 1] - 1].decode())
            else:
                kept.append(_without(words, d, a, gone[a:b]).decode())
        extra = pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            names=["kept_text", "n_words", "n_removed"],
        )
        return table.append_column(into, extra)

    return blocks.groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(clean, schema)


def _without(words: Words, d: int, a: int, gone: np.ndarray) -> bytes:
    """A text without its gone words; each kept word brings the white space before it."""
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return b""
    breaks = np.flatnonzero(np.diff(keep) > 1)
    runs = zip(keep[np.concatenate(([0], breaks + 1))].tolist(), keep[np.append(breaks, len(keep) - 1)].tolist())
    out = []
    for s, e in runs:
        begin = int(words.start[a + s]) if not out else int(words.end[a + s - 1])
        out.append(words.data[begin : int(words.end[a + e])])
    return b"".join(out)


def same_words(words: Words, at: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the words ``at`` are, byte for byte, the words data[start:end]: eight bytes at a time."""
    n = end - start
    same = words.end[at] - words.start[at] == n
    mine, other = (np.ndarray((len(x) + 1,), "<u8", x + bytes(8), strides=(1,)) for x in (words.data, data))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    live = np.flatnonzero(same)
    for k in range(LANES):
        if not len(live):
            return same
        part = mask[np.minimum(n[live] - 8 * k, 8)]
        ok = (mine[words.start[at[live]] + 8 * k] ^ other[start[live] + 8 * k]) & part == 0
        same[live[~ok]] = False
        live = live[ok & (n[live] > 8 * (k + 1))]
    for i in live.tolist():
        same[i] = words.data[words.start[at[i]] : words.end[at[i]]] == data[start[i] : end[i]]
    return same


def occurrences(words: Words, ids: np.ndarray, known: np.ndarray, phrases: list[bytes], first: list[int]) -> np.ndarray:
    """Flags of the words that an occurrence of a phrase (words joined by a space) covers, in a document larger than its first.

    Each word of the phrases is a number, and all other words are none, so
    automata of words run at the speed of characters. A word gets a number only
    if its bytes are those of the phrase's word.
    """
    least: dict[bytes, int] = {}
    for phrase, f in zip(phrases, first):
        least[phrase] = min(f, least.get(phrase, f))
    items = sorted(least.items())
    gone = np.zeros(len(words.hash) + 1, np.int64)
    # a word that no phrase has between two texts
    places = np.arange(len(words.hash)) + words.doc
    base = np.arange(1, PLACES * VALUES + 1, VALUES, dtype=np.uint32)
    for s in range(0, len(items), SHARD_PHRASES):
        shard = [(phrase.split(b" "), f) for phrase, f in items[s : s + SHARD_PHRASES]]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for phrase, _ in shard for w in phrase))}
        if len(number) > VALUES**PLACES:
            raise ValueError("a shard of phrases has more words than there are numbers")
        digits = np.arange(len(number), dtype=np.uint32)[:, None] // VALUES ** np.arange(PLACES, dtype=np.uint32) % VALUES + base
        signs = digits.astype("<u4").tobytes().decode("utf-32-le")
        name = [signs[i : i + PLACES] for i in range(0, len(signs), PLACES)]
        machine = ahocorasick.Automaton()
        for phrase, f in shard:
            machine.add_word("".join(name[number[w]] for w in phrase), (f, len(phrase)))
        machine.make_automaton()
        joined = b" ".join(number)
        start, end = word_places(joined)
        hashes = word_hashes(joined, start, end)
        order = np.argsort(hashes, kind="stable")
        near = order[np.minimum(np.searchsorted(hashes[order], words.hash), len(order) - 1)]
        at = np.flatnonzero(hashes[near] == words.hash)
        at = at[same_words(words, at, joined, start[near[at]], end[near[at]])]
        stream = np.zeros((len(words.hash) + len(ids), PLACES), "<u4")
        stream[places[at]] = digits[near[at]]
        if len(hashes) > 1 and (hashes[order][1:] == hashes[order][:-1]).any():
            # two words of one hash: each is looked up by itself
            for i in np.flatnonzero(np.isin(words.hash, hashes)).tolist():
                k = number.get(words.data[words.start[i] : words.end[i]])
                stream[places[i]] = 0 if k is None else digits[k]
        found = [(end // PLACES, f, n) for end, (f, n) in machine.iter(stream.tobytes().decode("utf-32-le"))]
        if found:
            last, f, n = np.array(found, np.int64).T
            last = np.searchsorted(places, last)
            doc = words.doc[last]
            ok = known[doc] & (f < ids[doc])
            np.add.at(gone, last[ok] + 1 - n[ok], 1)
            np.add.at(gone, last[ok] + 1, -1)
    return np.cumsum(gone[:-1]) > 0


def kept_words_digest(cleaned: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of what ``remove_repeats`` returned: kept words joined by one space."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "kept", 16 << 20):
            sha = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in batch.column("kept").to_pylist()]
            cols = [batch.column(c) for c in ("doc_id", "n_words", "n_removed")]
            yield pa.record_batch([*cols, pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    flat = cleaned.select(
        F.col(ident).alias("doc_id"), "_dedup.n_words", "_dedup.n_removed", F.col("_dedup.kept_text").cast("binary").alias("kept")
    )
    return flat.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
