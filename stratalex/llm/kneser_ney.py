"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model counts runs of five code points, whole Unicode, with no classes and no
hashes. Counts of all trusted text are added up by each block first and then
sharded; the orders of the model are made by joins of sharded counts. Documents
travel in blocks: a block asks the shards for its distinct runs once, the shards
answer from their counts, and the block adds up each document's perplexity. A
block of some MB has far fewer distinct runs than signs, so that join moves a
tenth of the text. Nothing that grows is gathered or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import Tables, blob_to_table, pack_blocks

ORDER = 5
#: The sign before the first one of a text.
PAD = "\x02"
#: Code points handled at a time; longer texts are cut, with the signs before a cut as context.
PIECE = 2 << 20
#: Of a block's rows, in bytes.
BLOCK_BYTES = 8 << 20
#: One trusted document in so many is not counted, and draws the upper bounds.
HELD_OUT = 4
#: Logarithms are answered in steps of one in so many.
STEPS = 1024
NONE = np.int16(-(1 << 15))


def pieces(texts: list[str | None], limit: int = PIECE) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Groups of (row, code points) of about ``limit`` signs; each piece begins with the ORDER - 1 signs before it."""
    pad = np.full(ORDER - 1, ord(PAD), np.uint32)
    group, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        points = np.concatenate((pad, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))
        for at in range(0, len(points) - len(pad), limit):
            piece = points[at : at + limit + len(pad)]
            if group and size + len(piece) > 2 * limit:
                yield group
                group, size = [], 0
            group.append((row, piece))
            size += len(piece)
    if group:
        yield group


def _ranks(key: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the rank of each key; without a sort where a table of all keys is small."""
    if space > 1 << 24:
        return np.unique(key, return_inverse=True)
    rank = np.zeros(space, np.int32)
    rank[key] = 1
    found = np.flatnonzero(rank)
    rank[found] = np.arange(len(found), dtype=np.int32)
    return found, rank[key]


class Grams:
    """The distinct runs of 1 to ORDER signs of a group of pieces.

    For order k, ``parent[k]`` and ``suffix[k]`` are the runs of order k - 1
    without the last and the first sign; numbers follow the order of the signs.
    ``at`` has the run of ORDER signs that ends at each sign of the pieces, and
    ``first`` where each piece begins in it.
    """

    def __init__(self, group: list[tuple[int, np.ndarray]]) -> None:
        self.rows = np.array([r for r, _ in group])
        signs = np.concatenate([p for _, p in group])
        sizes = np.array([len(p) for _, p in group])
        ends = np.cumsum(sizes)
        real = np.ones(len(signs), bool)
        for k in range(ORDER - 1):
            real[ends - sizes + k] = False
        self.first = np.cumsum(sizes - (ORDER - 1)) - (sizes - (ORDER - 1))
        seen = np.zeros(0x110000, np.int32)
        seen[signs] = 1
        alphabet = np.flatnonzero(seen)
        seen[alphabet] = np.arange(len(alphabet), dtype=np.int32)
        last = seen[signs]
        del signs
        n = len(alphabet)
        self.points = {1: alphabet.astype(np.uint32)[:, None]}
        self.parent: dict[int, np.ndarray] = {}
        self.suffix: dict[int, np.ndarray] = {}
        ids = last
        for k in range(2, ORDER + 1):
            key = last.astype(np.int64)
            key[1:] += ids[:-1].astype(np.int64) * n
            found, longer = _ranks(key, len(self.points[k - 1]) * n)
            del key
            where = np.zeros(len(found), np.int64)
            where[longer] = np.arange(len(longer))
            self.parent[k], self.suffix[k] = found // n, ids[where].astype(np.int64)
            self.points[k] = np.concatenate((self.points[k - 1][self.parent[k]], alphabet[found % n, None].astype(np.uint32)), axis=1)
            ids = longer
        self.at = ids[real]
        # what the signs of the pieces need
        self.used = {k: np.zeros(len(p), bool) for k, p in self.points.items()}
        self.used[ORDER][self.at] = True
        for k in range(ORDER, 1, -1):
            self.used[k - 1][self.parent[k][self.used[k]]] = True
            self.used[k - 1][self.suffix[k][self.used[k]]] = True

    def texts(self, order: int, chosen: np.ndarray) -> list[str]:
        whole = self.points[order][chosen].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[i : i + order] for i in range(0, len(whole), order)]

    def dealt(self, shards: int) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
        """(shard, runs of each order that live there); a run's shard is that of its first three signs."""
        shard = {}
        for k in self.points:
            if k <= 3:
                names = self.texts(k, np.arange(len(self.points[k])))
                shard[k] = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in names), np.uint64, len(names))
                shard[k] = shard[k].view(np.int64) % shards
            else:
                shard[k] = shard[k - 1][self.parent[k]]
        own = {k: np.flatnonzero(u) for k, u in self.used.items()}
        order = {k: own[k][np.argsort(shard[k][own[k]], kind="stable")] for k in own}
        cuts = {k: np.searchsorted(shard[k][order[k]], np.arange(shards + 1)) for k in own}
        for s in range(shards):
            part = {k: order[k][cuts[k][s] : cuts[k][s + 1]] for k in own}
            if any(len(x) for x in part.values()):
                yield s, part

    def ask(self, part: dict[int, np.ndarray]) -> bytes:
        """Runs as bytes: how many of each order, then their signs by columns."""
        counts = np.array([len(part[k]) for k in range(1, ORDER + 1)], "<u4")
        signs = np.concatenate([self.points[k][part[k]].T.ravel() for k in range(1, ORDER + 1)]).astype("<u4")
        return zstandard.compress(counts.tobytes() + signs.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), 3)

    def logs(self, p: dict[int, np.ndarray], g: dict[int, np.ndarray], unknown: float) -> np.ndarray:
        """ln p of each run of ORDER signs from ln p of seen runs and ln of the back-off weights of seen contexts (both NaN elsewhere)."""
        below = np.where(np.isnan(p[1]), np.log(unknown), p[1])
        for k in range(2, ORDER + 1):
            below = np.where(np.isnan(p[k]), np.nan_to_num(g[k - 1])[self.parent[k]] + below[self.suffix[k]], p[k])
        return below


def _packed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at most five signs (rows of code points) as two integers each, one for one."""
    wide = np.zeros((len(points), ORDER), np.int64)
    wide[:, : points.shape[1]] = points.astype(np.int64) + 1
    return wide[:, 0] << 42 | wide[:, 1] << 21 | wide[:, 2], wide[:, 3] << 21 | wide[:, 4]


class Lookup:
    """Values by run."""

    def __init__(self, names: list[str], values: np.ndarray) -> None:
        high, low = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        for k in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == k)
            signs = np.frombuffer("".join([names[i] for i in at.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            high[at], low[at] = _packed(signs.reshape(len(at), k))
        self.high = np.unique(high)
        key = np.searchsorted(self.high, high) << 42 | low
        order = np.argsort(key)
        self.key, self.values = key[order], values[order]

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """The values of rows of code points in steps, NONE where there is none."""
        out = np.full(len(points), NONE)
        if not len(self.key) or not len(points):
            return out
        high, low = _packed(points)
        top = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        key = top << 42 | low
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (self.high[top] == high)
        out[hit] = self.values[at[hit]]
        return out


def steps(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values * STEPS), -(1 << 15) + 1, (1 << 15) - 1).astype(np.int16)


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of one order from its counts of counts; an order too small to have them takes 0.5, 1, 1.5."""
    row = counts.agg(*(F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in range(1, 5))).first()
    n = [row[f"n{k}"] or 0 for k in range(1, 5)]
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


def fit(counts: DataFrame, tables: Tables) -> tuple[DataFrame, float] | None:
    """The model from (gram, c) of all runs of ORDER signs: rows (gram, weight, value) and p of an unknown sign; None without a run.

    ``value`` is p of a seen run, or with ``weight`` the back-off weight of a
    seen context. The lowest order is interpolated with an equal share for each
    seen sign and one for all others.
    """
    c = F.col("c")
    parts, lower, unknown = [], None, 0.0
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        # how many different signs stand before each shorter run
        shorter = by_order[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        by_order[k] = tables.put(shorter, f"kn-counts{k}")
    for k in range(1, ORDER + 1):
        d = discounts(by_order[k])
        held = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        if lower is None:
            row = by_order[k].agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("total"), F.sum(held).alias("held")).first()
            if not row["n"]:
                return None
            unknown = row["held"] / row["total"] / (row["n"] + 1)
            p = by_order[k].select("gram", ((c - held) / row["total"] + unknown).alias("p"))
        else:
            context = F.substring("gram", 1, k - 1)
            per = by_order[k].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), (F.sum(held) / F.sum("c")).alias("g"))
            per = tables.put(per, f"kn-contexts{k}")
            rows = by_order[k].withColumn("context", context).withColumn("low", F.substring("gram", 2, k - 1))
            rows = rows.join(per, "context").join(lower.select(F.col("gram").alias("low"), F.col("p").alias("p_low")), "low")
            p = rows.select("gram", ((c - held) / F.col("total") + F.col("g") * F.col("p_low")).alias("p"))
            parts.append(per.select(F.col("context").alias("gram"), F.lit(True).alias("weight"), F.col("g").alias("value")))
        lower = tables.put(p, f"kn-p{k}")
        parts.append(lower.select("gram", F.lit(False).alias("weight"), F.col("p").alias("value")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return model, unknown


def count_grams(blocks: DataFrame, chosen: DataFrame, text: str = "text", piece: int = PIECE) -> DataFrame:
    """(gram, c): the runs of ORDER signs of the rows (block, row) ``chosen`` of ``blocks``; each block adds its own up first."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names, values = [], []
        if left.num_rows and right.num_rows:
            table = blob_to_table(left.column("blob")[0].as_py()).select([text]).take(right.column("row"))
            for group in pieces(table.column(text).to_pylist(), piece):
                grams = Grams(group)
                own = np.flatnonzero(grams.used[ORDER])
                names += grams.texts(ORDER, own)
                values.append(np.bincount(grams.at, minlength=len(grams.used[ORDER]))[own])
        counted = np.concatenate(values) if values else np.zeros(0, np.int64)
        return pa.table({"gram": pa.array(names, pa.string()), "c": pa.array(counted, pa.int64())})

    counted = blocks.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(run, "gram string, c long")
    return counted.groupBy("gram").agg(F.sum("c").alias("c"))


def score(blocks: DataFrame, model: DataFrame | None, unknown: float, fields: str, text: str = "text", piece: int = PIECE) -> DataFrame:
    """All rows of ``blocks`` with the struct ``_quality``.

    ``perplexity`` is that of a sign, ``error`` the standard error of its
    logarithm; both are null without a sign or a model. ``fields`` is the schema
    of the rows.
    """
    spark = blocks.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "part", "runs"]
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                for part, group in enumerate(pieces(blob_to_table(blob.as_py()).column(text).to_pylist(), piece)):
                    grams = Grams(group)
                    rows = [(s, grams.ask(own)) for s, own in grams.dealt(shards)]
                    own = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.binary()))]
                    yield pa.record_batch([own[0], pa.array([block] * len(rows), pa.int64()), pa.array([part] * len(rows), pa.int32()), own[1]], names=names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, values, tables = None, ([], []), ([], []), None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "block", "part", "runs", "gram", "weight", "value")]
            out = []
            for s, block, part, runs, gram, weight, value in zip(*cols):
                if s != shard:
                    shard, names, values, tables = s, ([], []), ([], []), None
                if runs is None:
                    names[weight].append(gram)
                    values[weight].append(value)
                    continue
                if tables is None:
                    tables = [Lookup(n, steps(np.log(np.array(v, np.float64)))) for n, v in zip(names, values)]
                    names, values = ([], []), ([], [])
                raw = zstandard.decompress(runs)
                counts = np.frombuffer(raw, "<u4", ORDER).tolist()
                signs = np.frombuffer(raw[4 * ORDER :].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                found, at = [], 0
                for k, n in enumerate(counts, 1):
                    points = signs[at : at + k * n].reshape(k, n).T
                    at += k * n
                    found.append(tables[0](points))
                    if k < ORDER:
                        found.append(tables[1](points))
                out.append((s, block, part, zstandard.compress(np.concatenate(found).astype("<i2").tobytes(), 3)))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["shard", "block", "part", "found"])

    def judge_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        table = blob_to_table(left.column("blob")[0].as_py())
        n, total, square = (np.zeros(table.num_rows) for _ in range(3))
        if right.num_rows:
            answers = {(p, s): f for p, s, f in zip(*(right.column(c).to_pylist() for c in ("part", "shard", "found")))}
            for part, group in enumerate(pieces(table.column(text).to_pylist(), piece)):
                grams = Grams(group)
                p, g = ({k: np.full(len(x), np.nan) for k, x in grams.points.items()} for _ in range(2))
                for s, own in grams.dealt(shards):
                    found, at = np.frombuffer(zstandard.decompress(answers[part, s]), "<i2"), 0
                    for k in range(1, ORDER + 1):
                        for out in (p, g)[: 1 + (k < ORDER)]:
                            value = found[at : at + len(own[k])]
                            out[k][own[k]] = np.where(value == NONE, np.nan, value / STEPS)
                            at += len(own[k])
                each = grams.logs(p, g, unknown)[grams.at]
                np.add.at(n, grams.rows, np.diff(np.append(grams.first, len(each))))
                np.add.at(total, grams.rows, np.add.reduceat(each, grams.first))
                np.add.at(square, grams.rows, np.add.reduceat(each * each, grams.first))
        none = n == 0
        n = np.maximum(n, 1)
        error = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0) / n)
        extra = pa.StructArray.from_arrays([pa.array(x, pa.float64(), mask=none) for x in (np.exp(-total / n), error)], names=["perplexity", "error"])
        return table.append_column("_quality", extra)

    if model is None:
        answers = spark.createDataFrame([], "shard int, block long, part int, found binary")
    else:
        rows = model.select(F.pmod(F.xxhash64(F.substring("gram", 1, 3)), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("part"),
                            F.lit(None).cast("binary").alias("runs"), "gram", "weight", "value")
        asked = blocks.mapInArrow(requests, "shard int, block long, part int, runs binary").withColumns(
            {"gram": F.lit(None).cast("string"), "weight": F.lit(None).cast("boolean"), "value": F.lit(None).cast("double")}
        )
        both = rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block", "part")
        answers = both.mapInArrow(answer, "shard int, block long, part int, found binary")
    schema = f"{fields}, _quality struct<perplexity: double, error: double>"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge_block, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that labels call good and none calls bad or toxic."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.agg(F.min(good.cast("int")).alias("good")).where("good = 1").select("doc_id")


def held_out(ident: str | Column = "doc_id") -> Column:
    """Whether a trusted document stays out of the counts."""
    return F.pmod(F.xxhash64(F.lit("held"), ident), F.lit(HELD_OUT)) == 0


def thresholds(scored: DataFrame, trusted: DataFrame, quantile: float, slack: float) -> DataFrame:
    """(lang, low, high): bounds of perplexity by language from the trusted rows of ``scored`` (doc_id, lang, perplexity, error).

    The bounds are outer quantiles of what ``judge`` compares, so with the same
    allowance for short texts. They are drawn from the median and the outer
    decile of each language, whose distance in logarithms is lengthened as a
    normal distribution says, so single odd documents among the trusted ones do
    not move them; few rows lengthen it a little more, and ``slack`` widens all.
    Counted documents have a lower perplexity than others, so the upper bound
    comes from those held out, where there are any, and the lower one from all.
    Lang null has its own row. The row with ``any`` true holds those of all
    languages together, for languages without trusted rows.
    """
    own = scored.join(trusted, "doc_id", "left_semi").where("perplexity is not null").withColumn("held", held_out())
    room = F.exp(2 * F.col("error"))
    outer = NormalDist().inv_cdf(quantile) / NormalDist().inv_cdf(0.9)

    def bound(value, decile):
        middle, edge = F.percentile_approx(value, 0.5, 10_000), F.percentile_approx(value, decile, 10_000)
        return middle * F.exp(F.log(edge / middle) * outer * (1 + 8 / F.count(value)))

    low = bound(F.col("perplexity") * room, 0.1)
    high = bound(F.when(F.col("held"), F.col("perplexity") / room), 0.9)
    seen = bound(F.col("perplexity") / room, 0.9)
    both = own.rollup("lang").agg(F.grouping("lang").alias("any"), low.alias("low"), F.coalesce(high, seen).alias("high"))
    return both.select("lang", (F.col("any") == 1).alias("any"), (F.col("low") / slack).alias("low"), (F.col("high") * slack).alias("high"))


def judge(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    """``scored`` (lang, perplexity, error, ...) with low, high and keep; rows without a perplexity are not kept.

    A row goes if its perplexity lies beyond a bound by more than two standard
    errors, so a few signs do not condemn a text. Without any trusted row there
    are no bounds, and every row is kept.
    """
    per = bounds.where("not any").select(F.col("lang").alias("own_lang"), "low", "high")
    whole = bounds.where("any").agg(F.max("low").alias("all_low"), F.max("high").alias("all_high"))
    out = scored.join(per, F.col("lang").eqNullSafe(F.col("own_lang")), "left").join(F.broadcast(whole))
    out = out.withColumn("low", F.coalesce("low", "all_low")).withColumn("high", F.coalesce("high", "all_high"))
    room = F.exp(2 * F.col("error"))
    inside = F.col("perplexity").between(F.col("low") / room, F.col("high") * room)
    keep = F.when(F.col("high").isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))
    return out.withColumn("keep", keep).drop("own_lang", "all_low", "all_high")


def _scores(rows: DataFrame, trusted: DataFrame, tables: Tables, *names: str) -> DataFrame:
    """Columns ``names`` of ``rows`` (doc_id, lang, text, ...) with perplexity and error, as a table.

    Texts move once to be counted and once to be scored.
    """
    blocks = pack_blocks(rows, BLOCK_BYTES, level=6).repartition("block")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                ids = blob_to_table(blob.as_py()).column("doc_id").combine_chunks()
                yield pa.record_batch([pa.array([block] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), ids], names=["block", "row", "doc_id"])

    ids = blocks.mapInArrow(ids_of, "block long, row long, doc_id long")
    chosen = ids.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi").where(~held_out()).select("block", "row")
    counts = tables.put(count_grams(blocks, chosen), f"kn-counts{ORDER}")
    model, unknown = fit(counts, tables) or (None, 1.0)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema)
    scored = score(blocks, model, unknown, fields)
    return tables.put(scored.select(*names, "_quality.perplexity", "_quality.error"), "kn-scores")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, slack: float = 1.2) -> DataFrame:
    """(doc_id, lang, perplexity, error, low, high, keep) of each row of ``docs`` (doc_id, text, lang).

    The model and the bounds come from all documents that ``labels`` (doc_id,
    quality, toxic) trust. A text without a sign (null or empty) has no
    perplexity and is not kept; texts of any length are read whole, piece by
    piece; repeated rows are judged alike; other columns are not read. An empty
    table gives none, and without labels every row is kept.
    """
    tables, trusted = Tables(docs.sparkSession), trusted_ids(labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    scored = _scores(rows, trusted, tables, "doc_id", "lang")
    return judge(scored, thresholds(scored, trusted, quantile, slack))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, slack: float = 1.2) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; columns of any name may be there."""
    tables, trusted = Tables(docs.sparkSession), trusted_ids(labels)
    # the rows travel as one column, so that no name clashes
    row = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text"), row.dropFields("text").alias("row") if len(docs.columns) > 1 else row)
    scored = _scores(rows, trusted, tables, "doc_id", "lang", "text", "row")
    bounds = tables.put(thresholds(scored, trusted, quantile, slack), "kn-bounds")
    good = judge(scored, bounds).where("keep")
    return good.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
