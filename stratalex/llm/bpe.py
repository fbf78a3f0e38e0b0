"""Byte-level BPE: batched numpy merge rounds over the distinct words of a batch."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import chunks

#: Fixed value: the pattern by which byte-level tokenizers of this kind split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids in a worker, before it starts anew.
CACHE_WORDS = 400_000
NONE = np.int64(1 << 40)
#: Words of more bytes are merged by themselves, with ranks kept in stretches of so many places.
LONG, STRETCH = 2048, 512


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, the rest from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one vocabulary file (a tokenizers JSON with a byte-level BPE model)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(size)]
        self.base = np.array([vocab[c] for c in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word. A round merges, in every word at once, all its pairs of lowest rank from left to right."""
        long = {i for i, w in enumerate(words) if len(w) > LONG}
        if long:
            short = iter(self.merge([w for i, w in enumerate(words) if i not in long]))
            return [self.merge_long(w) if i in long else next(short) for i, w in enumerate(words)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)

        def price(at: np.ndarray) -> None:
            """Rank and outcome of the pairs that begin ``at``; the last symbol of a word begins none."""
            rank[at] = NONE
            at = at[at + 1 < len(sym)]
            at = at[word[at + 1] == word[at]]
            key = sym[at] << 20 | sym[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank[at[hit]], made[at[hit]] = self.ranks[found[hit]], self.made[found[hit]]

        price(np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            spans = np.diff(np.append(first, len(word)))
            low = np.repeat(np.minimum.reduceat(rank, first), spans)
            keep = low != NONE
            if not keep.all():
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
            # in a run of overlapping pairs (a a a) every second one merges
            pos = np.flatnonzero((rank == low) & keep)
            if not len(pos):
                break
            lone = np.concatenate(([True], (pos[1:] != pos[:-1] + 1) | (word[pos[1:]] != word[pos[:-1]])))
            start = np.maximum.accumulate(np.where(lone, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            sym[pos] = made[pos]
            keep[pos + 1] = False
            at = (np.cumsum(keep) - 1)[pos]
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            # only pairs with a new symbol have another rank
            price(np.concatenate([at, at[at > 0] - 1]))
        if not done_sym:
            return [()] * len(words)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        flat = sym[order].tolist()
        return [tuple(flat[s:e]) for s, e in zip([0, *ends[:-1]], ends)]

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """Ids of one long word. Rounds as above, but a round looks only at the places whose pairs have changed.

        Symbols are linked, so none moves. The lowest rank is found by the
        lowest of each stretch of places, which is kept up to date where a pair has changed.
        """
        n = len(word)
        stretches = -(-n // STRETCH)
        sym = np.append(self.base[np.frombuffer(word, np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank, made = np.full(stretches * STRETCH, NONE), np.zeros(stretches * STRETCH, np.int64)

        def price(at: np.ndarray) -> None:
            rank[at] = NONE
            at = at[after[at] < n]
            key = sym[at] << 20 | sym[after[at]]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank[at[hit]], made[at[hit]] = self.ranks[found[hit]], self.made[found[hit]]

        price(np.arange(n))
        low = rank.reshape(stretches, STRETCH).min(axis=1)
        while (best := low.min()) != NONE:
            near = np.flatnonzero(low == best)
            row, col = np.nonzero(rank.reshape(stretches, STRETCH)[near] == best)
            pos = near[row] * STRETCH + col
            # in a run of overlapping pairs (a a a) every second one merges
            lone = np.concatenate(([True], after[pos[:-1]] != pos[1:]))
            start = np.maximum.accumulate(np.where(lone, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            gone = after[pos]
            sym[pos] = made[pos]
            rank[gone] = NONE
            after[pos] = after[gone]
            before[np.minimum(after[pos], n)] = pos
            changed = np.concatenate([pos, before[pos]])
            changed = np.unique(changed[changed >= 0])
            price(changed)
            touched = np.unique(np.concatenate([changed, gone]) // STRETCH)
            low[touched] = rank.reshape(stretches, STRETCH)[touched].min(axis=1)
        out, at = [], 0
        while at < n:
            out.append(int(sym[at]))
            at = int(after[at])
        return tuple(out)

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token is a piece of its own."""
        if not self.split or not self.split.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, whole, in one batch."""
        parts = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if not self.cache:
            # a special token's text is no word of the pattern's but for the parts between its signs
            self.cache.update({t: (i,) for t, i in self.special.items()})
        new = list(set().union(*parts) - self.cache.keys())
        if new:
            self.cache.update(zip(new, self.merge([w.encode() for w in new])))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each vocabulary file and worker."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts of ``docs`` (doc_id, text); a null text is empty, with no ids.

    No shuffle: each task encodes its rows in batches of about 4 MB. Repeated
    rows and null ids pass through; other columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in chunks(batches, "text", 4 << 20):
            lists = own.encode([t or "" for t in batch.column("text").to_pylist()])
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.record_batch([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids); null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [own.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded`` (doc_id, ids); each row's ids are decoded again."""
    import hashlib

    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                ids = ids.to_numpy().tolist() if ids is not None else []
                listed = ",".join(map(own.text_of.__getitem__, ids)).encode()
                text = own.decode(ids).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
