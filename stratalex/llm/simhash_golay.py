"""SimHash near-duplicates, candidates by decoding fingerprint segments in a Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a
word of 23 bits. The binary Golay code of length 23 is perfect: each word lies
within three bits of one codeword, which has a 12-bit index. A word at distance
three from its codeword has five more codewords at distance four. Two words that
differ in one bit at most share a codeword that is nearest to the one and at
distance four or less from the other.

With four differing bits over three segments, either two segments differ in one
bit at most each, or one is equal and both others differ in two. The first case
is found by keys of two codeword indices (nearest of one segment, all near ones
of the other, in both orders); the second by the equal segment with one of three
parts of the next, of which two errors leave one clean. So no pair is missed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import Tables, chunks, connected_components, materialize, splitmix

GENERATOR = 0b110001110101
WIDTHS = (22, 21, 21)
SHIFTS = (0, 22, 43)
#: Rows of a bucket compared in one group; larger buckets are dealt in parts, and each pair of parts is a group.
BUCKET = 8192
#: Likewise for the sets of a loose group: rows, and shingles.
GROUP_ROWS, GROUP_SHINGLES = 2048, 4 << 20


def simhash64(text: bytes, shingle: int = 4, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """The fingerprints of one text, unsigned: words are runs without ASCII white space, A-Z lower-cased.

    A bit is set where it is set in over half the hashes of the shingles,
    repeats included. Fewer words than a shingle are one; no word gives 0.
    """
    words = text.lower().split()
    if not words:
        return [0] * len(seeds)
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(joined, s) for s in seeds]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    pieces = [joined[s:e] for s, e in zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    out = []
    for seed in seeds:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, itertools.repeat(seed)), np.uint64, len(pieces))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int32) * 2 > len(pieces)
        out.append(int(np.packbits(ones, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(doc_id long, fp0 long, ...) of whole texts, a word for each seed; a null text counts as empty, with fingerprint 0."""
    names = [f"fp{w}" for w in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 16 << 20):
            fps = np.array([simhash64(t or b"", shingle, seeds) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(fps[:, w]) for w in range(len(seeds)))], names=["doc_id", *names])

    schema = "doc_id long" + "".join(f", {n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


class Golay:
    """Tables of the (23, 12) code: syndrome to leader, and to the offsets of all codewords within distance four."""

    def __init__(self) -> None:
        single = np.zeros(23, np.int64)
        for bit in range(23):
            r = 1 << bit
            for k in range(bit, 10, -1):
                if r >> k & 1:
                    r ^= GENERATOR << (k - 11)
            single[bit] = r
        low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
        for table, first in ((low, 0), (high, 12)):
            for value in range(1, len(table)):
                bit = value.bit_length() - 1
                table[value] = table[value ^ (1 << bit)] ^ single[first + bit]
        self.low, self.high = low, high
        self.leader = np.zeros(1 << 11, np.int64)
        for weight in (1, 2, 3):
            for bits in itertools.combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self.leader[self.syndrome(np.array([word]))[0]] = word
        infos = np.arange(1 << 12, dtype=np.int64) << 11
        words = infos | self.syndrome(infos)
        seven = [int(w) for w in words if int(w).bit_count() == 7]
        #: Index offsets of the near codewords: the nearest itself, and five more where the leader has three bits.
        self.offsets = np.zeros((1 << 11, 6), np.int64)
        self.count = np.ones(1 << 11, np.int64)
        for syndrome, leader in enumerate(self.leader.tolist()):
            if leader.bit_count() == 3:
                near = [w >> 11 for w in seven if w & leader == leader]
                self.offsets[syndrome, 1 : 1 + len(near)] = near
                self.count[syndrome] = 1 + len(near)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the indices of near codewords (six columns, the nearest first) and how many are set."""
        s = self.syndrome(words)
        nearest = (words ^ self.leader[s]) >> 11
        return nearest[:, None] ^ self.offsets[s], self.count[s]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def keys_of(fps: np.ndarray, clean: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of 64-bit fingerprints: equal keys are candidates; each row's keys are distinct.

    ``clean`` adds the keys for one equal segment, which four errors need.
    """
    code = golay()
    segs = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    near = [code.near(x) for x in segs]
    rows_out, keys_out = [], []
    everyone = np.arange(len(fps))
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (near_i, n_i), (near_j, n_j) = near[i], near[j]
        for k in range(6):
            ok = everyone[n_j > k]  # nearest of i with each near one of j
            rows_out.append(ok)
            keys_out.append((kind << 50) | (near_i[ok, 0] << 12) | near_j[ok, k])
            if k:  # each further one of i with the nearest of j
                ok = everyone[n_i > k]
                rows_out.append(ok)
                keys_out.append((kind << 50) | (near_i[ok, k] << 12) | near_j[ok, 0])
    for i in range(3 if clean else 0):
        j = (i + 1) % 3
        for part in range(3):
            rows_out.append(everyone)
            keys_out.append(((3 + 3 * i + part) << 50) | (segs[i] << 8) | (segs[j] >> (7 * part) & (0xFF if part == 2 else 0x7F)))
    return np.concatenate(rows_out), np.concatenate(keys_out)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one or more words (the last axis)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _forest(fps: np.ndarray, ids: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the components of one bucket; each step compares one member with those not reached yet."""
    out = []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, members, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = _apart(fps[left], fps[queue.pop()]) <= bits
            if near.any():
                found = left[near]
                queue.extend(found.tolist())
                members.extend(found.tolist())
                left = left[~near]
        if len(members) > 1:
            own = ids[np.array(members)]
            out.append((np.full(len(own), own.min()), own))
    return out


def bucket_edges(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, bits: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets (rows sorted by key), enough to connect what is linked in each bucket."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    per_row = np.repeat(sizes, sizes)
    at = np.flatnonzero((per_row > 1) & (per_row <= small))
    k, f, d = keys[at], fps[at], ids[at]
    for shift in range(1, small):
        if len(k) <= shift:
            break
        hit = np.flatnonzero(k[shift:] == k[:-shift])
        hit = hit[_apart(f[hit + shift], f[hit]) <= bits]
        a.append(d[hit])
        b.append(d[hit + shift])
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        for x, y in _forest(fps[s : s + n], ids[s : s + n], bits):
            a.append(x)
            b.append(y)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    ok = a != b
    pairs = np.unique(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]]), axis=1)
    return pairs[0], pairs[1]


def in_parts(rows: DataFrame, sizes: DataFrame, key: str, *ident: str) -> DataFrame:
    """``rows`` with ``i`` and ``j``: a key with ``parts`` in ``sizes`` is dealt by ``ident``, and each row is in a group for each pair of its part with a part."""
    rows = rows.join(sizes, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*ident), F.col("parts"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("part", "q")).withColumn("j", F.greatest("part", "q")).drop("parts", "part", "q")


def links(nodes: DataFrame, words: int = 1, bits: int = 4, more: str | None = None, bucket: int = BUCKET, key_words: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the rows of ``nodes`` (id long; fp0, fp1, ...: distinct fingerprints of ``words`` 64-bit words).

    Rows link at ``bits`` differing bits or fewer over all words. Each of the
    first ``key_words`` words (all of them if not given) gives keys; with one word
    and four bits, no linked pair is left unconnected.
    The array column ``more`` holds further keys of each row. Buckets of more
    than ``bucket`` rows are dealt in parts.
    """
    names = [f"fp{w}" for w in range(words)]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                fps = [part.column(n).to_numpy(zero_copy_only=False) for n in names]
                ids = part.column("id").to_numpy(zero_copy_only=False)
                for w in range(key_words or words):
                    rows, keys = keys_of(fps[w].view(np.uint64), clean=words == 1)
                    keys |= w << 56
                    yield pa.record_batch([pa.array(x) for x in (keys, ids[rows], *(f[rows] for f in fps))], names=["key", "id", *names])
                if more:
                    lists = part.column(more)
                    rows = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
                    # negative: apart from the keys of codewords
                    keys = lists.flatten().to_numpy(zero_copy_only=False) | np.int64(-(1 << 63))
                    yield pa.record_batch([pa.array(x) for x in (keys, ids[rows], *(f[rows] for f in fps))], names=["key", "id", *names])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def done(parts):
            k, i, j, d, *f = (np.concatenate(x) for x in zip(*parts))
            new = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            x, y = bucket_edges(np.concatenate(([0], np.cumsum(new))), np.stack(f, axis=1).view(np.uint64), d, bits)
            return pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "id", *names))
            held.append(cols)
            rows += batch.num_rows
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))
            if rows >= 50_000 and len(change):  # all but the last group is whole
                cut = int(change[-1]) + 1
                yield done([*held[:-1], tuple(c[:cut] for c in cols)])
                held = [tuple(c[cut:] for c in cols)]
                rows = len(held[0][0])
        if held:
            yield done(held)

    fields = "".join(f", {n} long" for n in names)
    keyed = nodes.select("id", *names, *([more] if more else [])).mapInArrow(explode, f"key long, id long{fields}")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
    large, _ = materialize(large.select("key", F.ceil(F.col("n") / bucket).cast("long").alias("parts")), "simhash-large")
    keyed = in_parts(keyed, large, "key", "id", *names).select("key", "i", "j", "id", *names)
    return keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(verify, "a long, b long").distinct()


def _grouped(prints: DataFrame, words: int, bits: int) -> DataFrame:
    """``prints`` (doc_id, fp0, ...) with component_id; equal fingerprints are one node, so copies never meet in pairs."""
    names = [f"fp{w}" for w in range(words)]
    prints, _ = materialize(prints, "simhash")
    nodes, _ = materialize(prints.groupBy(*names).agg(F.min("doc_id").alias("id")), "simhash-nodes")
    parts = connected_components(links(nodes.where("id is not null"), words, bits))
    nodes = nodes.join(parts.withColumnRenamed("node", "id"), "id", "left")
    nodes = nodes.select(*names, F.coalesce("component", "id").alias("component_id"))
    return prints.join(nodes, names)


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text); other columns are not read.

    Links at ``bits`` (four at most) differing bits. Copies share a node and a
    dense group is linked by stars within each bucket, so no step makes all
    pairs of a group. A null or empty text has fingerprint 0; rows without an id
    carry their group's smallest id, or null; repeated rows are kept.
    """
    if bits > 4:
        raise ValueError("the keys of one word are complete up to four bits")
    prints = fingerprints(docs, shingle, (seed,))
    return _grouped(prints, 1, bits).select("doc_id", F.col("fp0").alias("fp"), "component_id")


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one text, words as in ``simhash64``; fewer words than a shingle are one, no word has none."""
    words = text.lower().split()
    pieces = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces)))


def set_simhash(hashes: np.ndarray, seeds: tuple[int, ...]) -> list[int]:
    """The fingerprints of a set of hashes, repeats of a text's shingles not counted; the empty set gives 0."""
    out = []
    for seed in seeds:
        mixed = splitmix(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        ones = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32) * 2 > len(hashes)
        out.append(int(np.packbits(ones, bitorder="little").view("<u8")[0]))
    return out


def alike(sets: list[np.ndarray], tenths: int = 8) -> np.ndarray:
    """For each set the smallest index of its component under Jaccard similarity of ``tenths`` / 10 or more.

    Each step compares one member with all sets not reached yet, so copies of
    one text cost a step and no pairs among them.
    """
    out = np.arange(len(sets))
    left = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    while len(left) > 1:
        first, queue = left[0], [left[0]]
        flat, left = flat[sizes[first] :], left[1:]
        while queue and len(left):
            own = sets[queue.pop()]
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            near = 10 * both >= tenths * (sizes[left] + len(own) - both)
            if near.any():
                out[left[near]] = first
                queue.extend(left[near].tolist())
                flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
    return out


def similar_documents(docs: DataFrame, shingle: int = 5, words: int = 3, bits: int = 64, seed: int = 42, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, component_id): components of documents whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Candidates: a SimHash of the set gives Golay keys, and the shingles of least
    hash that two sets at 0.8 must share one of (n - ceil(0.8 n) + 1 of n) are
    further keys, so no such pair misses a common key. Rows of a key that differ
    in ``bits`` of the wide fingerprint (``words`` SimHashes under different
    seeds) or fewer make loose groups; at 0.8 about 15 % of the bits
    differ (19 % of very short texts), so a third leaves out what only shares a
    passage. Within a loose group the sets themselves are compared, and only
    pairs at 0.8 are linked; a group of many rows or shingles is dealt in parts,
    and each pair of parts is compared by itself. Equal sets are one node. Texts
    without a word are not grouped with each other; they keep their own id. Rows
    of one id are one document. A null id is no node; an empty table gives none;
    other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    seeds = tuple(seed + w for w in range(words))
    names = [f"fp{w}" for w in range(words)]
    fields = "".join(f", {n} long" for n in names)

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            sets = [shingle_set(t or b"", shingle) for t in batch.column("text").to_pylist()]
            fps = np.array([set_simhash(x, seeds) for x in sets], np.uint64).view(np.int64)
            digests = [xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in sets]
            # n - ceil(0.8 n) + 1
            firsts = [x[: len(x) - (4 * len(x) + 4) // 5 + 1].view(np.int64) for x in sets]
            cols = [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(firsts, pa.list_(pa.int64())), *(pa.array(fps[:, w]) for w in range(words))]
            yield pa.record_batch(cols, names=["doc_id", "digest", "size", "firsts", *names])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    prints = tables.put(source.mapInArrow(prints_of, f"doc_id long, digest binary, size long, firsts array<long>{fields}"), "simhash-wide")
    nodes = tables.put(prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "simhash-sets")
    # one row for each set: that of its smallest id
    own = prints.join(nodes, (prints["digest"] == nodes["digest"]) & (prints["doc_id"] == nodes["id"])).select(nodes["digest"], "id", "size", "firsts", *names).dropDuplicates(["digest"])
    own = tables.put(own, "simhash-nodes")
    loose = connected_components(links(own, words, bits, "firsts", key_words=1)).withColumnRenamed("node", "id")
    loose = tables.put(loose, "simhash-loose")
    groups = loose.join(own.select("id", "size"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    parts = F.ceil(F.greatest(F.col("n") / group_rows, F.col("size") / GROUP_SHINGLES)).cast("long")
    large = tables.put(groups.select("component", parts.alias("parts")).where("parts > 1"), "simhash-large")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            sets = [shingle_set(t or b"", shingle) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh128_digest(x.tobytes()) for x in sets]
            cols = [batch.column("component"), batch.column("id"), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.record_batch(cols, names=["component", "id", "digest", "own"])

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("digest", "ascending")])
        label = alike([np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()])
        ids = table.column("id").to_numpy()
        linked = ids[label] != ids
        return pa.table({"a": pa.array(ids[label][linked]), "b": pa.array(ids[linked])})

    texts = source.withColumnRenamed("doc_id", "id").join(loose, "id").select("component", "id", "text")
    sets = texts.mapInArrow(sets_of, "component long, id long, digest binary, own binary")
    sets = sets.join(nodes, ["digest", "id"], "left_semi").dropDuplicates(["digest"])
    sets = in_parts(sets, large, "component", "digest").select("component", "i", "j", "id", "digest", "own")
    exact = connected_components(sets.groupBy("component", "i", "j").applyInArrow(verify, "a long, b long"))
    exact = exact.withColumnsRenamed({"node": "id", "component": "component_id"})
    named = nodes.join(exact, "id", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    full = prints.where("digest is not null").select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")
    full = full.unionByName(prints.where("digest is null").select("doc_id", F.col("doc_id").alias("component_id")))
    done, _ = materialize(full, "simhash-groups")
    tables.drop()
    return done
