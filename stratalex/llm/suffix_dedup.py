"""Removal of long strings that recur, by suffix arrays of the places where texts may agree.

1. Whole rows travel once, in blocks of some MB. The anchors of a block are the
   places whose gram of 32 bytes has the least hash among those of some window of
   200 bytes. Equal windows have the same anchor at the same offset, so a
   window recurs only around an anchor whose gram recurs.
2. Anchors are looked at with what lies around them, as far as a window reaches.
   Each different surrounding of a recurring gram is sent once, by one of the
   blocks that hold it, with the number of times it is there.
3. Surroundings of one gram meet in parts of bounded size. A gram with too
   many is split by ranges of the windows' offsets, as often as it takes: all
   windows of a range share a string longer than the gram, which makes smaller
   parts, and surroundings that agree as far as these windows go are one. Suffix
   arrays of each part (multikey quicksort, then blind tries) tell the windows that recur.
4. Blocks get the offsets of their places, and take out what windows cover.

Of a string that a third of all documents holds, each task sends one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import Tables, blob_to_table, checkpointed, chunks, pack_blocks, splitmix
from stratalex.llm.suffix_array import recurring_offsets

LEAST = 200
#: Different surroundings of one gram that meet in one part; more are split by longer strings.
PART = 256
#: Bytes of surroundings sorted at a time.
SORTED_BYTES = 8 << 20


def gram_size(least: int) -> int:
    """Bytes of a gram: a power of two, 32 at most, a quarter of a window at most."""
    return min(32, 1 << max(0, (least // 4).bit_length() - 1))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of ``data``, texts that end at ``ends`` one after the other, and the hash of the gram at each."""
    size = gram_size(least)
    n = len(data) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram, have = data.astype(np.uint64) + np.uint64(1), 1
    while have < size:
        gram = gram[:-have] * np.uint64(0xFF51AFD7ED558CCD + 2 * have) + gram[have:]
        have *= 2
    gram = splitmix(gram)
    # zero is for windows that no text has whole
    np.maximum(gram, np.uint64(1), out=gram)
    low = _sliding(gram, least - size + 1, np.minimum)
    for end in ends[:-1].tolist():
        low[max(0, end - least + 1) : end] = 0
    reach = least - size
    # a place is an anchor if it has the least hash of some window: the largest of the least ones is its own
    most = _sliding(np.concatenate([np.zeros(reach, np.uint64), low, np.zeros(reach, np.uint64)]), reach + 1, np.maximum)
    at = np.flatnonzero(most == gram[: len(most)])
    return at, gram[at]


class Block:
    """Texts of a block as bytes, one after the other."""

    def __init__(self, blob: bytes, text: str) -> None:
        self.table = blob_to_table(blob)
        texts = self.table.column(text).combine_chunks().cast(pa.large_binary())
        self.missing = texts.is_null().to_pylist()
        texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]

    def texts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the texts of the places begin and end."""
        text = np.searchsorted(self.offsets, at, "right") - 1
        return self.offsets[text], self.offsets[text + 1]

    def around(self, at: np.ndarray, least: int, low: np.ndarray | int, high: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where what windows of ``least`` bytes may cover, which begin ``low`` to ``high`` bytes before the places, begins and ends within the texts."""
        begin, end = self.texts(at)
        return np.maximum(begin, at - high), np.minimum(end, at + least - low)


#: What is asked of a block, besides the place: the part's key, the surrounding, how often it is there, and the offsets of windows.
ASKED = ("key", "gram", "around", "times", "low", "high")
#: Parts that the offsets of windows are split in.
FAN = 4


def parts_of(low: int, high: int) -> list[tuple[int, int]]:
    """low..high in ``FAN`` ranges at most."""
    n = min(FAN, high - low + 1)
    edges = [low + (high - low + 1) * k // n for k in range(n + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def _table(names: str, *cols) -> pa.Table:
    return pa.table([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c) for c in cols], names=names.split())


def remove_recurring(docs: DataFrame, text: str = "text", least: int = LEAST, block_bytes: int = 2 << 20, part: int = PART, into: str = "_dedup") -> DataFrame:
    """All rows and columns of ``docs``, with the struct ``into``: kept (binary), n_bytes, n_removed, spans (array of start, size).

    A byte of a text in UTF-8 goes if a string of ``least`` bytes covers it
    that also starts anywhere else, in the same text too; strings are judged as
    they come, not on what is left, and never cross texts. What is left may
    cut characters, so it is binary. A null text is empty. Repeated rows are
    texts like others and go as a whole, if they are long enough. Ids are not
    looked at; a text of any length is one row of its block. ``into`` must be no
    column of ``docs``. An empty table gives none.
    """
    if into in docs.columns:
        raise ValueError(f"{into} is a column already; name another")
    if least < 8:
        raise ValueError("strings must have eight bytes or more")
    spark, reach = docs.sparkSession, least - gram_size(least)
    search = _Search(least)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block"), batch.column("blob")):
                own = Block(blob.as_py(), text)
                at, gram = anchors(own.data, own.offsets[1:], least)
                yield pa.record_batch([pa.array([block.as_py()], pa.int64()), pa.array([blob.as_py()], pa.binary()), pa.array([at.astype("<i4").tobytes() + gram.astype("<u8").tobytes()], pa.binary())], names=["block", "blob", "anchors"])

    blocks = pack_blocks(docs, block_bytes, level=6).mapInArrow(anchored, "block long, blob binary, anchors binary")
    blocks = checkpointed(blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block"))
    tables = Tables(spark)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("anchors").to_pylist()):
                _, gram = _anchors(raw)
                gram, times = np.unique(gram, return_counts=True)
                yield from _table("block gram times", np.full(len(gram), block), gram, times).to_batches()

    rows = tables.put(blocks.select("block", "anchors").mapInArrow(grams, "block long, gram long, times long"), "suffix-grams")
    again = rows.groupBy("gram").agg(F.sum("times").alias("all")).where("all > 1").select("gram")
    recurring = Tables(spark)
    again = recurring.put(rows.select("block", "gram").join(again.hint("shuffle_hash"), "gram", "left_semi"), "suffix-recurring")
    tables.drop()

    def digests(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Each different surrounding of the block's recurring grams, by the hash of its bytes, with its places."""
        names = "block gram around times at"
        if not right.num_rows or not left.num_rows:
            return pa.table({n: pa.array([], pa.list_(pa.int32()) if n == "at" else pa.int64()) for n in names.split()})
        own, (at, gram) = Block(left.column("blob")[0].as_py(), text), _anchors(left.column("anchors")[0].as_py())
        known = np.sort(right.column("gram").to_numpy().view(np.uint64))
        hit = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
        at, gram = at[hit], gram[hit]
        begin, end = own.around(at, least, 0, reach)
        data, places = own.data.tobytes(), {}
        for p, g, a, b in zip(at.tolist(), gram.view(np.int64).tolist(), begin.tolist(), end.tolist()):
            places.setdefault((g, xxhash.xxh3_64_intdigest(data[a:b], p - a)), []).append(p)
        g, around = np.array([k[0] for k in places], np.int64), np.array([k[1] for k in places], np.uint64)
        return _table(names, np.full(len(g), key[0].as_py()), g, around, pa.array([len(v) for v in places.values()], pa.int64()), pa.array(list(places.values()), pa.list_(pa.int32())))

    kinds = Tables(spark)
    held = blocks.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(digests, "block long, gram long, around long, times long, at array<int>")
    held = kinds.put(held, "suffix-digests")
    recurring.drop()
    # one of the blocks tells the bytes of each surrounding
    told = held.groupBy("gram", "around").agg(F.sum("times").alias("times"), F.min(F.struct("block", F.col("at")[0].alias("at"))).alias("by"))
    told = tables.put(told.select("gram", "around", "times", "by.block", "by.at"), "suffix-told")

    def say(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes that windows at the asked offsets may cover."""
        if not right.num_rows or not left.num_rows:
            return pa.table({n: pa.array([], pa.binary() if n == "bytes" else pa.int64()) for n in (*ASKED, "before", "bytes")})
        own, at = Block(left.column("blob")[0].as_py(), text), right.column("at").to_numpy()
        begin, end = own.around(at, least, right.column("low").to_numpy(), right.column("high").to_numpy())
        data = own.data.tobytes()
        said = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
        return pa.table({**{n: right.column(n) for n in ASKED}, "before": pa.array(at - begin), "bytes": said})

    def divide(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Each surrounding for each part of its offsets: the hash of what all its windows share, and of all that they cover."""
        names = [*ASKED, "block", "at", "around_part", "first", "last"]
        if not right.num_rows or not left.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        own, at = Block(left.column("blob")[0].as_py(), text), right.column("at").to_numpy()
        data, rows = own.data.tobytes(), []
        begins, ends = own.texts(at)
        columns = [right.column(n).to_pylist() for n in ("gram", "around", "times", "at", "low", "high")]
        for gram, around, times, p, low, high, begin, end in zip(*columns, begins.tolist(), ends.tolist()):
            for a, b in parts_of(low, high):
                if p - begin < a or end - p < least - b:
                    continue
                x, y = max(begin, p - b), min(end, p + least - a)
                shared = xxhash.xxh3_64_intdigest(data[p - a : p + least - b], gram % 2**63 + (a << 8) + b)
                first, last = max(a, least - (end - p)), min(b, p - begin)
                rows.append((shared - 2**63, gram, around, times, a, b, key[0].as_py(), p, xxhash.xxh3_64_intdigest(data[x:y], p - x) - 2**63, first, last))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows) if rows else [()] * len(names))})

    def asked(rows: DataFrame, run, schema: str) -> DataFrame:
        return blocks.select("block", "blob").groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)

    # a gram with few surroundings is one part; the others are split by the offsets of windows
    sizes = told.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"))
    large = tables.put(sizes.where(F.col("kinds") > part).select("gram"), "suffix-large")
    whole = {"key": F.col("gram"), "low": F.lit(0).cast("long"), "high": F.lit(reach).cast("long")}
    small = told.join(large, "gram", "left_anti").withColumns(whole).select("block", "at", *ASKED)
    sure = None
    rows = told.join(large, "gram", "left_semi").withColumns(whole).select("block", "at", *ASKED)
    while not large.isEmpty():
        kinds_of = f"{', '.join(f'{n} long' for n in ASKED)}, block long, at long, around_part long, first long, last long"
        rows = tables.put(asked(rows, divide, kinds_of), "suffix-parts")
        who = F.min(F.struct("block", "at", "gram", "around")).alias("by")
        each = rows.groupBy("key", "low", "high", "around_part").agg(F.sum("times").alias("times"), who)
        each = tables.put(each.select("key", "low", "high", "around_part", "times", "by.*"), "suffix-each")
        # what windows of these offsets cover is there more than once: all of them recur
        often = each.where("times > 1").select("key", "around_part")
        found = rows.join(often.hint("shuffle_hash"), ["key", "around_part"], "left_semi").select("gram", "around", F.col("first").cast("int").alias("low"), F.col("last").cast("int").alias("high"))
        sure = found if sure is None else sure.unionByName(found)
        sizes = tables.put(each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all")).where("all > 1"), "suffix-sizes")
        few = sizes.where(F.col("kinds").between(2, part)).select("key")
        small = small.unionByName(each.join(few.hint("shuffle_hash"), "key", "left_semi").select("block", "at", *ASKED))
        large = sizes.where(F.col("kinds") > part).select("key")
        rows = each.join(large.hint("shuffle_hash"), "key", "left_semi").select("block", "at", *ASKED)
    spoken = asked(small, say, f"{', '.join(f'{n} long' for n in ASKED)}, before long, bytes binary")
    offsets = spoken.repartition("key").sortWithinPartitions("key").mapInArrow(search.run, "gram long, around long, low int, high int")
    if sure is not None:
        offsets = offsets.unionByName(sure)
    offsets = offsets.groupBy("gram", "around").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    places = held.select("gram", "around", "block", "at").join(offsets.hint("shuffle_hash"), ["gram", "around"]).select("block", "at", "low", "high")
    places = Tables(spark).put(places, "suffix-places")
    tables.drop()
    kinds.drop()

    flat = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{flat}, `{into}` struct<kept: binary, n_bytes: bigint, n_removed: bigint, spans: array<struct<start: bigint, size: bigint>>>"

    def clean(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own = Block(left.column("blob")[0].as_py(), text)
        edges = np.zeros(len(own.data) + 1, np.int64)
        if right.num_rows:
            lists = right.column("at").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            at = lists.flatten().to_numpy().astype(np.int64)
            low, high = (np.repeat(right.column(c).to_numpy().astype(np.int64), size) for c in ("low", "high"))
            np.add.at(edges, at - high, 1)
            np.add.at(edges, at + least - low, -1)
        gone = np.cumsum(edges[:-1]) > 0
        kept, sizes, removed, spans = [], [], [], []
        for a, b in zip(own.offsets[:-1].tolist(), own.offsets[1:].tolist()):
            mine = gone[a:b]
            turn = np.flatnonzero(np.diff(mine, prepend=False, append=False))
            kept.append(own.data[a:b][~mine].tobytes())
            sizes.append(b - a)
            removed.append(int(mine.sum()))
            spans.append([{"start": s, "size": e - s} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist())])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
        extra = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)]
        return own.table.append_column(into, pa.StructArray.from_arrays(extra, names=["kept", "n_bytes", "n_removed", "spans"]))

    return blocks.select("block", "blob").groupBy("block").cogroup(places.groupBy("block")).applyInArrow(clean, schema)


def _anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, "<i4", n).astype(np.int64), np.frombuffer(raw, "<u8", n, 4 * n)


class _Search:
    """Suffix arrays of parts of surroundings."""

    def __init__(self, least: int) -> None:
        self.least = least

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: each part as a whole, many small ones at a time."""
        held, size = [], 0
        for batch in chunks(batches, "bytes", SORTED_BYTES):
            key = batch.column("key").to_numpy()
            # the last key may go on in the next batch
            cut = int(np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > -(2**63) else key[0] + 1))[-1])
            if size + batch.nbytes >= SORTED_BYTES and (cut or held and held[-1].column("key")[-1].as_py() != key[0]):
                yield from self.solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, size = [batch.slice(cut)], batch.slice(cut).nbytes
            else:
                held.append(batch)
                size += batch.nbytes
        if held:
            yield from self.solve(pa.Table.from_batches(held))

    def solve(self, rows: pa.Table) -> list[pa.RecordBatch]:
        rows = rows.combine_chunks()
        if not rows.num_rows:
            return []
        texts = rows.column("bytes").combine_chunks().cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        key, times, before, low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "times", "before", "low", "high"))
        group = np.cumsum(np.diff(key, prepend=key[0]) != 0)
        start = offsets[:-1] + before
        low, high = recurring_offsets(np.frombuffer(data, np.uint8), start, before, offsets[1:] - start, group, times, low, high, self.least)
        hit = np.flatnonzero(low >= 0)
        out = {"gram": rows.column("gram").take(hit), "around": rows.column("around").take(hit), "low": pa.array(low[hit], pa.int32()), "high": pa.array(high[hit], pa.int32())}
        return pa.table(out).to_batches()


def kept_digest(cleaned: DataFrame, ident: str = "doc_id", into: str = "_dedup") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what ``remove_recurring`` returned."""
    x = lambda name: F.col(f"`{into}`.{name}")
    return cleaned.select(
        F.col(ident).alias("doc_id"), x("n_bytes").alias("n_bytes"), x("n_removed").alias("n_removed"), F.size(x("spans")).cast("long").alias("n_spans"), F.sha2(x("kept"), 256).alias("kept_sha256")
    )
