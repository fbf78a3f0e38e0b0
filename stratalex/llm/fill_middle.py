"""Fill-in-middle: a text is cut at two seeded ranks of units and put in another order between marks.

The matcher streams twice over a text. The first pass counts the units; the
second advances a lazy match iterator to the smaller and then to the larger
rank. Nothing is stored but a place in the text and a count, whatever the
number of units. An iterator takes strides of many units where it can, which is
one call of the regular expression each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import chunks

#: Units that one call of the matcher takes, the largest first.
STRIDES = (4096, 256, 16, 1)


@dataclass(frozen=True)
class Layout:
    """Marks before prefix, suffix and middle; shares of texts in a hundred that change, and of those that begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    changed: int = 90
    suffix_first: int = 20

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self) -> None:
        if any(not a or (a != b and a in b) for a in self.marks for b in self.marks) or len(set(self.marks)) < 3:
            raise ValueError("marks must be three different texts, none within another")
        # a text without marks gives an output that splits in one way only if no mark begins as another ends
        if any(a[-k:] == b[:k] for a in self.marks for b in self.marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("no mark may begin with what one ends with")


class Units:
    """A lazy iterator over the units of a text: a place, and how many units lie before it."""

    def __init__(self, matchers: list[tuple[int, re.Pattern]], text: str) -> None:
        self.matchers, self.text = matchers, text
        self.place = self.rank = 0

    def advance(self, rank: int | None = None) -> int:
        """Go on to ``rank``, or to the end of the units; the place there."""
        for stride, matcher in self.matchers:
            while rank is None or self.rank + stride <= rank:
                found = matcher.match(self.text, self.place)
                if found is None:
                    break
                self.place = found.end()
                self.rank += stride
        return self.place


class Matcher:
    """Units of a text by a regular expression: successive matches, each where the last one ended.

    A unit must not be empty, and the units must cover the whole text: a text with a rest is an error.
    """

    def __init__(self, unit: str = r"(?s:.)") -> None:
        if re.compile(unit).match(""):
            raise ValueError("a unit must not be empty")
        # code points need no atomic group, and are faster without
        group = unit if unit == r"(?s:.)" else f"(?>{unit})"
        self.matchers = [(k, re.compile(group + ("" if k == 1 else f"{{{k}}}"))) for k in STRIDES]

    def count(self, text: str) -> int:
        units = Units(self.matchers, text)
        if units.advance() != len(text):
            raise ValueError("the units do not cover the text")
        return units.rank

    def places(self, text: str, low: int, high: int) -> tuple[int, int]:
        """Places in ``text`` after ``low`` and after ``high`` units, low <= high."""
        units = Units(self.matchers, text)
        return units.advance(low), units.advance(high)


def draws(ident: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the hex sha256 of the seed, a colon and the id in decimal (nothing for a null id)."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(text: str, ident: int | None, seed: int, matcher: Matcher, layout: Layout) -> tuple:
    """(n, form, output, prefix_chars, middle_chars) of one text; the last two are none where the form is plain."""
    n = matcher.count(text)
    h1, h2, h3, h4 = draws(ident, seed)
    if not text or any(m in text for m in layout.marks) or h3 % 100 >= layout.changed:
        return n, "plain", text, None, None
    a, b = matcher.places(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = layout.marks
    if h4 % 100 < layout.suffix_first:
        return n, "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", a, b - a
    return n, "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", a, b - a


def transform(docs: DataFrame, ident: str = "doc_id", text: str = "text", seed: int = 1, unit: str = r"(?s:.)", layout: Layout = Layout(), into: str = "_fim") -> DataFrame:
    """All rows and columns of ``docs``, with the struct ``into``: n, form, output, prefix_chars, middle_chars.

    n counts units. A null text is empty; empty texts and texts that hold a mark
    are plain: the output is the text, and the lengths are null. A null id has
    draws of its own, equal ids have equal draws, repeated rows equal results. A text of
    any length is read in place, twice, and no list of its units is made. No
    shuffle; ``into`` must be no column of ``docs``. An empty table gives none.
    """
    if into in docs.columns:
        raise ValueError(f"{into} is a column already; name another")
    names, at, key = docs.columns, docs.columns.index(text), docs.columns.index(ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(unit)
        for part in chunks(batches, f"c{at}", 4 << 20):
            pairs = zip(part.column(at), part.column(key).to_pylist())
            rows = [transformed(t.as_py() or "", i, seed, matcher, layout) for t, i in pairs]
            n, form, output, prefix, middle = zip(*rows)
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
            extra = pa.StructArray.from_arrays(columns, names=["n", "form", "output", "prefix_chars", "middle_chars"])
            yield pa.RecordBatch.from_arrays([*part.columns, extra], names=[*part.schema.names, "made"])

    # numbered columns, as a name may hold any sign
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    plain = plain.withColumn(f"c{key}", F.col(f"c{key}").cast("long"))
    flat = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    made = "made struct<n: bigint, form: string, output: string, prefix_chars: bigint, middle_chars: bigint>"
    return plain.mapInArrow(run, f"{flat}, {made}").toDF(*names, into)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def restored(output: Column, form: Column, layout: Layout = Layout()) -> Column:
    """The text again, from output and form alone."""
    parts = F.split(output, "|".join(re.escape(m) for m in layout.marks), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame, ident: str = "doc_id", into: str = "_fim", layout: Layout = Layout()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of what ``transform`` returned."""
    x = lambda name: F.col(f"{_quoted(into)}.{name}")
    return made.select(
        F.col(_quoted(ident)).alias("doc_id"), x("n").alias("n"), x("form").alias("form"), x("prefix_chars").alias("prefix_chars"), x("middle_chars").alias("middle_chars"),
        F.sha2(x("output"), 256).alias("output_sha256"), F.sha2(restored(x("output"), x("form"), layout), 256).alias("restored_sha256"),
    )
