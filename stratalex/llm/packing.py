"""Conflict-constrained best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import chunks, materialize


#: Equal rows that one row is written out as at a time.
WRITTEN = 65_536


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n, cluster, serial): words without ASCII white space, and the duplicate cluster (same words, A-Z lower-cased).

    ``serial`` numbers equal rows. They are counted and written out again, so
    numbers do not follow how rows are dealt over tasks. A null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 16 << 20):
            words = [(t or b"").lower().split() for t in batch.column("text").to_pylist()]
            cluster = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
            cols = [batch.column("doc_id"), batch.column("source"), pa.array([len(w) for w in words], pa.int64()), pa.array(cluster)]
            yield pa.record_batch(cols, names=["doc_id", "source", "n", "cluster"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("binary"))
    key = ["doc_id", "source", "n", "cluster"]
    each = rows.mapInArrow(run, "doc_id long, source string, n long, cluster long").groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    part = each.select(*key, "k", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / WRITTEN))).alias("part"))
    serial = F.sequence(F.col("part") * WRITTEN, F.least(F.col("k"), (F.col("part") + 1) * WRITTEN) - 1)
    return part.select(*key, F.explode(serial).alias("serial"))


class Bins:
    """Open bins in the order of the room left, each with bitmaps of its sources and its duplicate clusters."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.rooms: list[int] = []  # distinct residuals, ascending
        self.at: dict[int, list[int]] = {}  # residual -> bins
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.source_bit: dict = {}
        self.cluster_bit: dict = {}

    def _slot(self, bin_: int, first: int) -> int:
        """A free bit of the source in a bin, or 0. A source has ``per_source`` bits."""
        taken = self.sources[bin_] >> first & ((1 << self.per_source) - 1)
        free = ~taken & (taken + 1)
        return free << first if free >> self.per_source == 0 else 0

    def put(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset) for a piece: the tightest bin that fits and has no conflict, else a new one."""
        first = self.source_bit.setdefault(source, len(self.source_bit) * self.per_source)
        own = 1 << self.cluster_bit.setdefault(cluster, len(self.cluster_bit))
        for k in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[k]
            bins = self.at[room]
            for i, bin_ in enumerate(bins):
                if not self.clusters[bin_] & own and (slot := self._slot(bin_, first)):
                    del bins[i]
                    if not bins:
                        del self.at[room], self.rooms[k]
                    return self._keep(bin_, room, size, slot, own)
        self.sources.append(0)
        self.clusters.append(0)
        return self._keep(len(self.sources) - 1, self.capacity, size, 1 << first, own)

    def _keep(self, bin_: int, room: int, size: int, slot: int, own: int) -> tuple[int, int]:
        self.sources[bin_] |= slot
        self.clusters[bin_] |= own
        left = room - size
        if left:
            if left not in self.at:
                insort(self.rooms, left)
                self.at[left] = []
            self.at[left].append(bin_)
        return bin_, self.capacity - room


def pack(docs: DataFrame, capacity: int = 4096, per_source: int = 4, block_rows: int = 4096) -> DataFrame:
    """(bin, doc_id, piece, start, length, offset): the words of every row of ``docs`` (doc_id, text, source) in bins.

    A document longer than ``capacity`` words is cut into whole bins and a
    rest. No bin holds two documents of one duplicate cluster, nor more than
    ``per_source`` of one source (null is a source). Rows are dealt by a hash of
    their id, content and number among equal rows into blocks of about ``block_rows``, each packed in
    decreasing size; bins of different blocks are never shared, and do not follow how the rows came. A row without
    words (a null text, say) has bin null and length 0. Equal rows are packed each, in different
    blocks as it falls; a null id is packed like others. A very long text is one row whose words are counted; an
    empty table gives none; other columns are not read.
    """
    items, _ = materialize(sizes(docs), "pack-items")
    blocks = max(1, -(-items.count() // block_rows))
    mixed = F.xxhash64("doc_id", "cluster", "source", "n", "serial")
    dealt = items.withColumn("block", F.pmod(mixed, F.lit(blocks))).withColumn("rest", F.col("n") % capacity)
    dealt = dealt.repartition("block").sortWithinPartitions("block", F.desc("rest"), "source", "cluster", "doc_id")
    names = ["bin", "doc_id", "piece", "start", "length", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, serial = None, None, 0
        for batch in batches:
            out = []
            for block, ident, source, n, cluster in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "source", "n", "cluster"))):
                if block != now:
                    open_, now, serial = Bins(capacity, per_source), block, 0
                if not n:
                    out.append((None, ident, 0, 0, 0, 0))
                    continue
                whole, rest = divmod(n, capacity)
                for piece in range(whole):
                    out.append(((block << 32) | (1 << 31) | serial, ident, piece, piece * capacity, capacity, 0))
                    serial += 1
                if rest:
                    bin_, offset = open_.put(rest, source, cluster)
                    out.append(((block << 32) | bin_, ident, whole, whole * capacity, rest, offset))
            cols = zip(*out) if out else ((),) * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)

    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))
