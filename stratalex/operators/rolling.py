"""Statistics of windows that roll over a document, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def entropies(codes: np.ndarray, width: int) -> np.ndarray:
    """Bits of each row of ``codes`` (rows of ``width`` numbers): equal numbers are counted as runs of the sorted row."""
    rows = np.sort(codes, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    at = np.flatnonzero(new.ravel())
    n = np.diff(np.append(at, rows.size)).astype(np.float64)
    lost = np.bincount(at // width, n * np.log2(n), len(rows))
    return np.log2(width) - lost / width


def window_entropies(docs: DataFrame, width: int, step: int) -> DataFrame:
    """(doc_id, windows, mean_h, spread) of ``docs`` (doc_id, toks): windows of ``width`` words, one every ``step`` words before the last ``width``.

    Documents with ``width`` words or fewer have no window and no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("toks")
            words = lists.flatten().dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = []
            for ident, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if b - a <= width:
                    continue
                h = entropies(np.lib.stride_tricks.sliding_window_view(codes[a:b], width)[: b - a - width : step], width)
                out.append((ident, len(h), float(h.mean()), float(h.max() - h.min())))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "windows", "mean_h", "spread"])

    return docs.select("doc_id", "toks").mapInArrow(run, "doc_id long, windows long, mean_h double, spread double")
