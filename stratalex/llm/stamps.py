"""Mixed timestamp normalisation by a table-driven automaton and votes.

The layouts are compiled into one deterministic automaton. All stamps of an
Arrow batch advance through it at once, a byte a step, straight from the string
buffers; each step adds the byte to the register that the transition names. The
accepting state tells the layout, and the registers hold its fields.

Dates with slashes may be day first or month first. Stamps that are possible in
one order only vote for it in their source. Votes are added up by task and then
by source, and the open stamps are resolved by them. Wall times are placed by
the changes of their zone.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import materialize

#: White space at the ends, month names, and the first two digits of a year.
SPACE = " \t\n\x0b\x0c\r"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
CENTURY = "20"

#: Registers; the first takes what belongs to no field.
NONE, LEAD, SECOND, THIRD, HOUR, MINUTE, SECONDS, HALF, SIGN, OFF_HOUR, OFF_MINUTE, REGISTERS = range(12)
#: Layouts, by what their accepting states are called.
EPOCH, MILLIS, DASHED, SOLID, DOTTED, NAMED, SLASHED = range(1, 8)

DIGITS = "0123456789"


class Automaton:
    """Tables of a deterministic automaton over bytes: next state, register and its change, and layout of each state."""

    def __init__(self) -> None:
        self._edges: list[list[tuple[str, int, int, int, int]]] = [[]]
        self._free: list[list[int]] = [[]]
        self._layout: dict[int, int] = {}
        for layout, build in LAYOUTS.items():
            self._layout[build(self, 0)] = layout
        self._determine()

    # building: each method leads on from a state and returns the state it ends in

    def _state(self) -> int:
        self._edges.append([])
        self._free.append([])
        return len(self._edges) - 1

    def one(self, at: int, signs: str, register: int = NONE, values: list[int] | None = None, keep: int = 10) -> int:
        """One of ``signs``; its value goes to ``register``, which is multiplied by ``keep`` before."""
        to = self._state()
        for i, c in enumerate(signs):
            self._edges[at].append((c, register, keep, values[i] if values else (DIGITS.find(c) if register else 0), to))
        return to

    def number(self, at: int, register: int, size: int) -> int:
        for _ in range(size):
            at = self.one(at, DIGITS, register)
        return at

    def year(self, at: int, register: int) -> int:
        for c in CENTURY:
            at = self.one(at, c, register)
        return self.number(at, register, 2)

    def month(self, at: int, register: int) -> int:
        to = self._state()
        for i, name in enumerate(MONTHS):
            last = self.one(self.one(at, name[0]), name[1])
            self._free[self.one(last, name[2], register, [i + 1], 0)].append(to)
        return to

    def maybe(self, at: int, build) -> int:
        to = self._state()
        self._free[at].append(to)
        self._free[build(at)].append(to)
        return to

    def either(self, at: int, *builds) -> int:
        to = self._state()
        for build in builds:
            self._free[build(at)].append(to)
        return to

    def time(self, at: int) -> int:
        """Perhaps a time of day, with half of the day and offset from UTC."""

        def clock(a: int) -> int:
            a = self.number(self.one(self.number(self.one(a, "T "), HOUR, 2), ":"), MINUTE, 2)
            a = self.maybe(a, lambda b: self.number(self.one(b, ":"), SECONDS, 2))
            a = self.maybe(a, lambda b: self.one(self.one(self.maybe(b, space), "AP", HALF, [1, 2]), "M"))
            return self.maybe(a, lambda b: self.either(self.maybe(b, space), utc, offset))

        def space(a: int) -> int:
            return self.one(a, " ")

        def utc(a: int) -> int:
            return self.one(a, "Z", SIGN, [1])

        def offset(a: int) -> int:
            a = self.number(self.one(a, "+-", SIGN, [1, 2]), OFF_HOUR, 2)
            return self.number(self.maybe(a, lambda b: self.one(b, ":")), OFF_MINUTE, 2)

        return self.maybe(at, clock)

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self._free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _determine(self) -> None:
        """Sets of states become states. A byte must do one thing only, whatever layout it turns out to be."""
        first = self._closure({0})
        number, todo = {first: 1}, [first]
        rows: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        while todo:
            here = todo.pop()
            by: dict[str, list] = {}
            for s in here:
                for c, register, keep, value, to in self._edges[s]:
                    by.setdefault(c, []).append(((register, keep, value), to))
            for c, ways in by.items():
                actions = {action for action, _ in ways}
                if len(actions) > 1:
                    raise ValueError(f"layouts differ in what {c!r} does: {actions}")
                to = self._closure({t for _, t in ways})
                if to not in number:
                    number[to] = len(number) + 1
                    todo.append(to)
                rows[number[here], ord(c)] = (number[to], *actions.pop())
        n = len(number) + 1
        # state 0 is dead: nothing leads out of it
        self.next, self.register, self.keep, self.add = (np.zeros(n * 256, np.int32) for _ in range(4))
        for (s, c), (to, register, keep, value) in rows.items():
            i = s * 256 + c
            self.next[i], self.register[i], self.keep[i], self.add[i] = to, register, keep, value
        self.layout = np.zeros(n, np.int8)
        for states, s in number.items():
            kinds = {self._layout[x] for x in states if x in self._layout}
            if len(kinds) > 1:
                raise ValueError(f"a stamp has several layouts: {kinds}")
            self.layout[s] = kinds.pop() if kinds else 0

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Layout of each text (0: none), and the registers, one row each. A null has no layout."""
        texts = pa.compute.fill_null(pa.compute.utf8_trim(texts, characters=SPACE), "").cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        state = np.ones(n, np.int32)
        registers = np.zeros(REGISTERS * n, np.int64)
        live, step = np.arange(n), 0
        while len(live := live[size[live] > step]):
            i = state[live] * 256 + data[offsets[live] + step]
            cell = self.register[i].astype(np.int64) * n + live
            registers[cell] = registers[cell] * self.keep[i] + self.add[i]
            state[live] = self.next[i]
            live, step = live[self.next[i] > 0], step + 1
        return self.layout[state], registers.reshape(REGISTERS, n)


#: How each layout reads, from a state of the automaton to its last one.
LAYOUTS = {
    EPOCH: lambda a, at: a.number(at, LEAD, 10),
    MILLIS: lambda a, at: a.number(at, LEAD, 13),
    DASHED: lambda a, at: a.time(a.number(a.one(a.number(a.one(a.year(at, LEAD), "-"), SECOND, 2), "-"), THIRD, 2)),
    SOLID: lambda a, at: a.time(a.number(a.year(at, LEAD), LEAD, 4)),
    DOTTED: lambda a, at: a.time(a.year(a.one(a.number(a.one(a.number(at, LEAD, 2), "."), SECOND, 2), "."), THIRD)),
    NAMED: lambda a, at: a.time(a.year(a.one(a.month(a.one(a.number(at, LEAD, 2), " "), SECOND), " "), THIRD)),
    SLASHED: lambda a, at: a.time(a.year(a.one(a.number(a.one(a.number(at, LEAD, 2), "/"), SECOND, 2), "/"), THIRD)),
}


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


def days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days from 1970 to a date, and whether there is such a date."""
    ok = (month >= 1) & (month <= 12)
    m = (np.where(ok, (year - 1970) * 12 + month - 1, 0)).astype("M8[M]")
    first, after = m.astype("M8[D]").astype(np.int64), (m + 1).astype("M8[D]").astype(np.int64)
    return first + day - 1, ok & (day >= 1) & (day <= after - first)


#: Wall times lie in these years; changes of a zone are looked for a little beyond them.
SINCE, UNTIL = dt.datetime(1999, 12, 25, tzinfo=dt.UTC), dt.datetime(2100, 1, 8, tzinfo=dt.UTC)


@lru_cache(maxsize=1024)
def changes(zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Wall seconds from which the offset after a change holds, wall seconds until which a change makes a time doubtful, and the offsets, one more; none for an unknown zone."""
    try:
        own = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(second: int) -> int:
        return int(dt.datetime.fromtimestamp(second, own).utcoffset().total_seconds())

    begin, end, day = int(SINCE.timestamp()), int(UNTIL.timestamp()), 86400
    offsets, since, until = [offset(begin)], [], []
    for t in range(begin, end, day):
        if offset(t + day) == offsets[-1]:
            continue
        low, high = t, t + day
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if offset(middle) != offsets[-1] else (middle, high)
        old, new = offsets[-1], offset(high)
        # skipped and repeated times alike take the offset after the change
        since.append(high + min(old, new))
        until.append(high + max(old, new))
        offsets.append(new)
    return np.array(since, np.int64), np.array(until, np.int64), np.array(offsets, np.int64)


def placed(wall: np.ndarray, zones: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTC seconds of the wall seconds of ``rows`` in their zones, whether the zone is known, and whether it skips or repeats the time."""
    utc, known, doubtful = wall.copy(), np.zeros(len(wall), bool), np.zeros(len(wall), bool)
    named = zones.dictionary_encode()
    names, which = named.dictionary.to_pylist(), named.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for k, name in enumerate(names):
        at = rows[which[rows] == k]
        if not len(at) or (found := changes(name)) is None:
            continue
        since, until, offsets = found
        i = np.searchsorted(since, wall[at], "right")
        utc[at] = wall[at] - offsets[i]
        known[at] = True
        doubtful[at] = (i > 0) & (wall[at] < np.append(until, 0)[np.maximum(i, 1) - 1]) if len(until) else False
    return utc, known, doubtful


def parse(raw: pa.Array, zones: pa.Array) -> dict[str, np.ndarray]:
    """What the stamps say by themselves.

    rule: 0 bad, 1 epoch, 2 plain, 3 open (days and months of a slashed date
    may change places). first, month_first: UTC microseconds, the second for open ones. doubtful:
    whether the zone skips or repeats the first. vote: 1 for day first, -1 for month first.
    """
    layout, r = automaton().run(raw)
    solid, dashed, slashed = layout == SOLID, layout == DASHED, layout == SLASHED
    year = np.where(solid, r[LEAD] // 10000, np.where(dashed, r[LEAD], r[THIRD]))
    month = np.where(solid, r[LEAD] // 100 % 100, r[SECOND])
    day = np.where(solid, r[LEAD] % 100, np.where(dashed, r[THIRD], r[LEAD]))
    dated = layout >= DASHED
    half, hour = r[HALF], r[HOUR]
    clock = (r[MINUTE] <= 59) & (r[SECONDS] <= 59) & (r[OFF_HOUR] <= 14) & (r[OFF_MINUTE] <= 59)
    clock &= np.where(half > 0, (hour >= 1) & (hour <= 12), hour <= 23)
    hour = np.where(half > 0, hour % 12 + 12 * (half == 2), hour)
    second = hour * 3600 + r[MINUTE] * 60 + r[SECONDS]
    offset = np.where(r[SIGN] == 2, -1, 1) * (r[OFF_HOUR] * 3600 + r[OFF_MINUTE] * 60)
    fixed = r[SIGN] > 0

    def instant(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        date, ok = days(np.where(dated, y, 1970), m, d)
        wall, ok = date * 86400 + second, ok & dated & clock
        utc, known, doubtful = placed(wall, zones, np.flatnonzero(ok & ~fixed))
        return np.where(fixed, wall - offset, utc), ok & (fixed | known), doubtful & ~fixed

    first, good, doubtful = instant(year, month, day)
    month_first, turned, month_doubtful = instant(year, day, month)
    turned &= slashed
    epoch = (layout == EPOCH) | (layout == MILLIS)
    rule = np.where(epoch, 1, np.where(good | turned, 2, 0)).astype(np.int8)
    rule[good & turned & (day != month)] = 3
    only = turned & ~good
    first, doubtful = np.where(only, month_first, first) * 1_000_000, np.where(only, month_doubtful, doubtful)
    first = np.where(epoch, r[LEAD] * np.where(layout == EPOCH, 1_000_000, 1000), first)
    vote = (slashed & (good != turned)) * np.where(good, 1, -1)
    return {
        "rule": rule, "first": first, "doubtful": doubtful.astype(bool) & (rule >= 2), "month_first": month_first * 1_000_000,
        "vote": vote.astype(np.int8),
    }


#: An order wins with more than so many times the other's votes.
LEAD_OF_VOTES = 10
#: Parts that the stamps of a source are dealt in where votes are met by a shuffle.
PARTS = 32


def normalise(stamps: DataFrame, raw: str = "raw", source: str = "source", zone: str = "zone", into: str = "_stamp") -> DataFrame:
    """All rows and columns of ``stamps`` with the struct ``into``: utc_us, rule (bad, epoch, votes, default, plain), ambiguous.

    Stamps that are null, empty, impossible or of no known layout, and wall times
    whose zone is null or unknown, are bad: utc_us is null, they are not
    ambiguous and have no vote. A stamp of any length is read to the first
    byte that no layout has. A null source is a source like others; repeated
    rows vote each. Stamps with offset need no zone. ``into`` must be no column
    of ``stamps``. An empty table gives none.

    Two passes over the stamps and no list of them: the votes, one row a source
    and task, meet by source; the second pass looks its source's winner up.
    Where the winners are few (the optimizer checks their size) they go to the tasks,
    otherwise rows meet them by source and part, so no source is one task.
    """
    if into in stamps.columns:
        raise ValueError(f"{into} is a column already; name another")
    names = stamps.columns
    at = {k: names.index(c) for k, c in (("raw", raw), ("source", source), ("zone", zone))}
    plain = stamps.toDF(*(f"c{i}" for i in range(len(names))))

    def columns(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
        return batch.column(f"c{at['raw']}").cast(pa.string()), batch.column(f"c{at['zone']}").cast(pa.string())

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vote = parse(*columns(batch))["vote"]
            cast = np.flatnonzero(vote)
            if len(cast):
                rows = pa.table({"source": batch.column(f"c{at['source']}").take(pa.array(cast)), "day": pa.array((vote[cast] > 0).astype(np.int64)), "month": pa.array((vote[cast] < 0).astype(np.int64))})
                rows = rows.group_by("source", use_threads=False).aggregate([("day", "sum"), ("month", "sum")])
                yield from rows.select(["source", "day_sum", "month_sum"]).rename_columns(["source", "day", "month"]).to_batches()

    kind = stamps.schema[at["source"]].dataType.simpleString()
    cast = plain.select(*(f"c{i}" for i in dict.fromkeys(at.values()))).mapInArrow(ballots, f"source {kind}, day long, month long")
    votes = cast.groupBy("source").agg(F.sum("day").alias("day"), F.sum("month").alias("month"))
    won = votes.select("source", F.when(F.col("day") > LEAD_OF_VOTES * F.col("month"), "d").when(F.col("month") > LEAD_OF_VOTES * F.col("day"), "m").alias("winner")).where("winner is not null")
    won, _ = materialize(won, "stamp-votes")
    won = won.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("w_source"), F.col("source").isNull().alias("w_none"), "winner", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("w_part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            found = parse(*columns(batch))
            made = pa.StructArray.from_arrays([pa.array(found[c]) for c in MADE], names=list(MADE))
            part = pa.array((np.arange(batch.num_rows) + k) % PARTS, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, made, part], names=[*batch.schema.names, "made", "part"])

    flat = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    schema = f"{flat}, made struct<{', '.join(f'{k}: {v}' for k, v in MADE.items())}>, part int"
    rows = plain.mapInArrow(read, schema)
    own = F.col(f"c{at['source']}")
    met = rows.join(won, (F.coalesce(own.cast("string"), F.lit("")) == F.col("w_source")) & (own.isNull() == F.col("w_none")) & (F.col("part") == F.col("w_part")), "left")
    opened, turned = F.col("made.rule") == 3, F.coalesce(F.col("winner") == "m", F.lit(False))
    rule = F.when(opened, F.when(F.col("winner").isNotNull(), "votes").otherwise("default")).otherwise(F.element_at(F.array(*map(F.lit, ("bad", "epoch", "plain"))), F.least(F.col("made.rule"), F.lit(2)) + 1))
    result = F.struct(
        F.when(F.col("made.rule") > 0, F.when(opened & turned, F.col("made.month_first")).otherwise(F.col("made.first"))).alias("utc_us"),
        rule.alias("rule"), (opened | F.col("made.doubtful")).alias("ambiguous"),
    )
    return met.select(*(f"c{i}" for i in range(len(names))), result.alias("made")).toDF(*names, into)


#: What the second pass carries for each stamp.
MADE = {"rule": "tinyint", "first": "bigint", "doubtful": "boolean", "month_first": "bigint"}
