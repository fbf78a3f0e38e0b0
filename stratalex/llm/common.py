"""Helpers shared by the corpus operators: blocks of rows, and what the rest of the library offers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pyarrow.ipc  # noqa: F401  (pa.ipc)
import xxhash
from pyspark.sql import DataFrame

from stratalex.operators.graph import connected_components
from stratalex.session import Tables, checkpointed, drop_path, materialize, shared_dir

__all__ = [
    "Tables", "blob_to_table", "checkpointed", "chunks", "connected_components", "drop_path", "materialize", "pack_blocks",
    "shared_dir", "splitmix", "table_to_blob", "word_hashes", "word_places",
]


def pack_blocks(df: DataFrame, block_bytes: int, level: int = 3) -> DataFrame:
    """(block long, blob binary): the rows of ``df`` in blocks of about ``block_bytes``.

    A blob is an Arrow stream with zstandard bodies of ``level``, so whole rows
    travel through a shuffle in half the bytes. A row larger than a block has its own.
    """
    names = df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def emit():
            nonlocal seq, held, size
            blob = table_to_blob(pa.Table.from_batches(held), level)
            out = pa.record_batch([pa.array([(part << 32) | seq], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])
            seq, held, size = seq + 1, [], 0
            return out

        for batch in batches:
            batch, at = pa.RecordBatch.from_arrays(batch.columns, names=names), 0
            while at < batch.num_rows:
                per_row = max(1, batch.nbytes // max(1, batch.num_rows))
                take = min(batch.num_rows - at, max(1, (block_bytes - size) // per_row))
                piece = batch.slice(at, take)
                while take > 1 and piece.nbytes > 2 * block_bytes:
                    take //= 2
                    piece = batch.slice(at, take)
                held.append(piece)
                size += piece.nbytes
                at += take
                if size >= block_bytes:
                    yield emit()
        if held:
            yield emit()

    # numbered columns, as a name may hold any sign
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(pack, "block long, blob binary")


def table_to_blob(table: pa.Table, level: int = 3) -> bytes:
    sink = io.BytesIO()
    table = table.combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as writer:
        writer.write_table(pa.Table.from_batches([pa.RecordBatch.from_arrays([_own(c) for c in table.columns], schema=table.schema)]))
    return sink.getvalue()


def _own(column: pa.ChunkedArray) -> pa.Array:
    """A copy without the parts of larger buffers that a slice would carry along."""
    chunk = column.combine_chunks()
    chunk = chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk
    return pa.concat_arrays([chunk, chunk.slice(0, 0)])


def blob_to_table(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as reader:
        return reader.read_all()


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose ``column`` holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        col = batch.column(column)
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin and end; words are runs without ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], white, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Words of more bytes are hashed one by one.
LANES = 8


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the words data[start:end]: eight bytes at a time, mixed one after the other."""
    n = end - start
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    h = splitmix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero(n > 0)
    for k in range(LANES):
        if not len(at):
            return h
        h[at] = splitmix(h[at] ^ splitmix((lanes[start[at] + 8 * k] & mask[np.minimum(n[at] - 8 * k, 8)]) + np.uint64(k)))
        at = at[n[at] > 8 * (k + 1)]
    for i in at.tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    return h
