"""Embedding near-dedup by spherical-cap filters with structured product codes.

A filter is a direction made of one code vector for each block of dimensions, so
a few code vectors make very many directions, and all directions that a vector
exceeds are found block by block without trying each (list decoding). A vector
lives in its best filter and asks in all filters whose score is nearly as good.
Rows of a filter are ids at first; only where a filter has an owner and a second
row are vectors fetched, and verified in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import Tables, connected_components, materialize

#: A vector may have so many filters on average, in a trial with random vectors.
FILTERS = 24


class ProductCode:
    """``blocks`` random codes of ``size`` vectors each, after a random rotation.

    ``reach`` is how far below its best filter a vector still asks, in standard
    deviations of what two vectors at cosine ``least`` differ by in a filter's
    score.
    """

    def __init__(self, dim: int, size: int, least: float, reach: float, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.blocks, self.size, self.reach = max(1, min(4, dim // 4)), size, reach
        wide = -(-dim // self.blocks) * self.blocks
        self.turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim]
        code = rng.standard_normal((self.blocks, size, wide // self.blocks))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(self.blocks)
        self.step = np.sqrt(1 - least * least) / np.sqrt(wide)

    @classmethod
    def fitting(cls, dim: int, size: int, least: float, reach: float) -> ProductCode:
        """A code of at most ``size`` vectors a block; few dimensions have room for fewer directions that differ."""
        trial = np.random.default_rng(5).standard_normal((64, dim))
        trial /= np.linalg.norm(trial, axis=1, keepdims=True)
        while True:
            code = cls(dim, size, least, reach)
            if size <= 2 or len(code.decode(trial)[0]) <= FILTERS * len(trial):
                return code
            size = max(2, size * 3 // 4)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each unit vector asks in, and each vector's best filter.

        A prefix of blocks is dropped as soon as the best of the other blocks
        cannot lift it over the vector's bound.
        """
        parts = (unit @ self.turn).reshape(len(unit), self.blocks, -1)
        scores = np.einsum("nbd,bkd->nbk", parts, self.code)
        best, top = scores.max(axis=2), scores.argmax(axis=2)
        home = np.zeros(len(unit), np.int64)
        for b in range(self.blocks):
            home = home * self.size + top[:, b]
        whole = best.sum(axis=1)
        rest = np.concatenate((np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(unit), 1))), axis=1)
        bound = whole - self.reach * self.step * np.sqrt(np.maximum(1 - whole * whole, 0)) - 1e-12
        row, found, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b in range(self.blocks):
            sums = total[:, None] + scores[row, b]
            r, k = np.nonzero(sums + rest[row, b][:, None] >= bound[row][:, None])
            row, found, total = row[r], found[r] * self.size + k, sums[r, k]
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        # rounding must not lose a vector's own filter
        own = np.zeros(len(unit), bool)
        own[row[found == home[row]]] = True
        row, found = np.append(row, np.flatnonzero(~own)), np.append(found, home[~own])
        return row, found, home


def unit_rows(lists: pa.Array, dim: int, which: np.ndarray) -> np.ndarray:
    """The chosen lists of ``dim`` numbers as unit vectors in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    x = flat[starts[which][:, None] + np.arange(dim)]
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_links(unit: np.ndarray, ids: np.ndarray, copies: np.ndarray, home: np.ndarray, asks: list[np.ndarray | None], here: int, side: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(ids, links counted here, smallest id of the component here) of one filter's rows, or of two parts of them.

    Pairs of which one row at least lives in filter ``here`` meet. ``side`` is 0
    for rows of the first part and 1 for those of the second; all 0 compares the
    rows with each other. A pair may meet a second time where its other row
    lives, if the first one asks there (``asks``: the filters of those that live
    here); it is counted in the smaller filter of the two.
    """
    n = np.zeros(len(ids))
    label = np.arange(len(ids))
    owners = np.flatnonzero(home == here)
    where, column = np.unique(home, return_inverse=True)
    for at in range(0, len(owners), 512):
        own = owners[at : at + 512]
        near = unit[own] @ unit.T >= least
        near[np.arange(len(own)), own] = False
        if side.any():
            near &= side[own][:, None] != side[None, :]
        live = np.flatnonzero(near.any(axis=1))
        if not len(live):
            continue
        near, own = near[live], own[live]
        twice = np.stack([np.isin(where, asks[i]) for i in own.tolist()])[:, column]
        # pairs of two owners are seen from both sides, others from one
        both = (home == here)[None, :]
        counted = near & (both | ~twice | (here < home)[None, :])
        n[own] += counted.astype(np.float64) @ copies
        n += copies[own] @ (counted & ~both)
        for i, row in zip(own.tolist(), near):
            names = np.unique(np.append(label[row], label[i]))
            if len(names) > 1:
                label[np.isin(label, names[1:])] = names[0]
    linked = np.bincount(label, minlength=len(ids))[label] > 1
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    return ids[linked], n[linked], smallest[label][linked]


def near_duplicates(vectors: DataFrame, least: float = 0.98, bucket: int = 8192, reach: float = 1.3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine is
    ``least`` or more. Vectors that are null, empty, zero or hold null or
    non-finite parts link with nothing, and dimensions must agree to link.
    Equal vectors are one node with a number of copies, so copies never meet;
    rows of one vec_id with different vectors are taken for one node of all
    their links. There are about as many filters as rows, so a filter's rows do
    not grow with the table; one that still has more than ``bucket`` (a dense
    group) is dealt in parts, and each pair of parts is a group of its own.
    Other columns are not read; an empty table gives none.
    """
    tables = Tables(vectors.sparkSession)
    source = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    size = max(4, int(np.ceil(max(1, vectors.count()) ** 0.25)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        names = ["vec_id", "label", "dim", "digest", "home", "asks"]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                v = part.column("v")
                sizes, good = _good(part)
                home, asks = np.zeros(part.num_rows, np.int64), [None] * part.num_rows
                for dim in np.unique(sizes[good]).tolist():
                    own = np.flatnonzero(good & (sizes == dim))
                    if dim not in codes:
                        codes[dim] = ProductCode.fitting(dim, size, least, reach)
                    row, found, home[own] = codes[dim].decode(unit_rows(v, dim, own))
                    order = np.argsort(row, kind="stable")
                    for i, x in zip(own.tolist(), np.split(found[order], np.cumsum(np.bincount(row, minlength=len(own)))[:-1])):
                        asks[i] = x
                digests = [hashlib.blake2b(memoryview(x), digest_size=16).digest() if g else None for x, g in zip(_raw(v), good)]
                cols = [part.column("vec_id"), part.column("label"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(home), pa.array(asks, pa.list_(pa.int64()))]
                yield pa.record_batch(cols, names=names)

    schema = "vec_id long, label long, dim int, digest binary, home long, asks array<long>"
    rows = tables.put(source.mapInArrow(decode, schema), "cap-rows")
    key = ["label", "dim", "digest"]
    nodes = rows.where("digest is not null").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("home").alias("home"), F.first("asks").alias("asks"))
    nodes = tables.put(nodes, "cap-nodes")
    place = ["label", "dim", "filter"]
    asked = nodes.select(*key, "id", "copies", "home", "asks", F.explode("asks").alias("filter"))
    lives = (F.col("home") == F.col("filter")).cast("int")
    busy = asked.select(*place, lives.alias("lives")).groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("lives").alias("lives")).where("n > 1 and lives = 1")
    busy = busy.select(*place, F.ceil(F.col("n") / bucket).cast("long").alias("parts"))
    live = asked.withColumn("asks", F.when(lives == 1, F.col("asks"))).join(busy, place)
    live = tables.put(live.select(*key, "filter", "parts", "id", "copies", "home", "asks"), "cap-live")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            _, good = _good(part)
            digests = [hashlib.blake2b(memoryview(x), digest_size=16).digest() if g else None for x, g in zip(_raw(part.column("v")), good)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())], names=[*part.schema.names, "digest"])

    kind = source.schema["v"].dataType.simpleString()
    # one row for each node that meets another
    fetched = source.mapInArrow(named, f"vec_id long, label long, v {kind}, digest binary").where("digest is not null")
    wanted = live.select("label", "digest", "id").distinct()
    fetched = fetched.join(wanted.withColumnRenamed("id", "vec_id"), ["vec_id", "label", "digest"], "left_semi").dropDuplicates(["vec_id", "label", "digest"])
    keyed = live.join(fetched.withColumnRenamed("vec_id", "id"), ["id", "label", "digest"])
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.col("parts")))
    keyed = keyed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = [*place, "i", "j"]
    keyed = keyed.select(*place, F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "id", "copies", "home", "asks", "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "low"]
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            k = np.stack([table.column(c).to_numpy().astype(np.int64) for c in group])
            starts = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [k.shape[1]]))
            out = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a < 2:
                    continue
                g = table.slice(a, b - a).combine_chunks().to_batches()[0]
                part, i, j, ids, copies, home = (g.column(c).to_numpy() for c in ("part", "i", "j", "id", "copies", "home"))
                unit = unit_rows(g.column("v"), int(k[1, a]), np.arange(b - a))
                asks = g.column("asks").to_numpy(zero_copy_only=False).tolist()
                out.append(bucket_links(unit, ids, copies, home, asks, int(k[2, a]), (part == j) & (i != j), least))
            if not out:
                return pa.record_batch([pa.array([], pa.int64())] * 3, names=names)
            ids, n, low = (np.concatenate(x) for x in zip(*out))
            return pa.record_batch([pa.array(ids), pa.array(np.rint(n).astype(np.int64)), pa.array(low)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in group])
            change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
            if len(held) > 1 and not len(change):
                # the group may end between two batches
                last = held[-2].slice(held[-2].num_rows - 1)
                if any(last.column(c)[0].as_py() != batch.column(c)[0].as_py() for c in group):
                    yield done(pa.Table.from_batches(held[:-1]))
                    held = [batch]
            elif len(change):
                cut = int(change[-1]) + 1
                yield done(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield done(pa.Table.from_batches(held))

    dealt = keyed.repartition(*group).sortWithinPartitions(*group, "id")
    found, _ = materialize(dealt.mapInArrow(verify, "id long, n long, low long"), "cap-links")
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = nodes.select(*key, "id", "copies").join(counts, "id", "left").join(parts, "id", "left").select(
        *key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    linked = rows.where("digest is not null").join(known, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _raw(lists: pa.Array) -> list[np.ndarray]:
    """Each list's numbers; a negative zero is a zero."""
    flat = lists.flatten().to_numpy(zero_copy_only=False) + 0
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _good(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions, and which rows can link: an id, a label and a vector of finite parts that are not all zero."""
    v = part.column("v")
    sizes = np.diff(v.offsets.to_numpy())
    good = (sizes > 0) & np.asarray(v.is_valid()) & np.asarray(part.column("vec_id").is_valid()) & np.asarray(part.column("label").is_valid())
    flat = v.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(x) | np.asarray(flat.is_null())
    row = np.repeat(np.arange(len(sizes)), sizes)
    good &= np.bincount(row, bad, len(sizes)) == 0
    return sizes, good & (np.bincount(row, np.where(bad, 0, x != 0), len(sizes)) > 0)
