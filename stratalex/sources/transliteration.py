"""Transliterations of pages as a data source: files in splits of some MB, and a writer of the same format.

A page header ``<f1r>`` holds for all lines until the next, wherever a file is
cut. A split that begins within a page looks backwards for its header, so
splits are read apart from each other, and a page of any length takes many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratalex.session import ship_package

#: The patterns of the format, and what a page's variables are called.
HEADER = r"^<(f\d+[rv]\d?)>\s*(.*)"
LOCUS = r"^<([^>]+)>\s*(.*)"
VARIABLES = {"quire": r"\$Q=(\d+)", "page_num": r"\$P=(\d+)", "language": r"\$L=([AB])", "hand": r"\$H=(\d+)", "illustration": r"\$I=(\w)", "cluster": r"\$C=(\w+)"}
LETTERS = {"quire": "Q", "page_num": "P", "language": "L", "hand": "H", "illustration": "I", "cluster": "C"}
NUMBERS = ("quire", "page_num", "hand")

#: Bytes that are read at a time, and of a split.
PIECE, SPLIT = 1 << 20, 16 << 20
#: Bytes that a header before its closing bracket has at most.
HEADER_BYTES = 256


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class Lines:
    """Lines of a byte range of a file: those that begin in it."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.size = stream, size

    def bytes(self, start: int, end: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(max(0, end - start))

    def first(self, start: int) -> int:
        """Where the first line begins that begins at ``start`` or later."""
        at = start - 1
        if at < 0:
            return 0
        while at < self.size:
            piece = self.bytes(at, min(self.size, at + PIECE))
            found = piece.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(piece)
        return self.size

    def between(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        """(offset, line) of the lines that begin from ``start``, where one begins, to before ``end``."""
        at, rest = start, b""
        while at < end and at < self.size:
            piece = self.bytes(at + len(rest), min(self.size, at + len(rest) + PIECE))
            whole = rest + piece
            *lines, rest = whole.split(b"\n")
            if not piece:
                lines, rest = [rest], b""
            for line in lines:
                if at >= end:
                    return
                yield at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line) + 1

    def header_before(self, start: int) -> int | None:
        """Where the last header line before ``start`` begins; none if there is none."""
        end, tail = start, b""
        while end > 0:
            low = max(0, end - PIECE)
            piece = self.bytes(max(0, low - 1), end)
            piece = (b"\n" + piece if low == 0 else piece) + tail
            found = [m.start() for m in re.finditer(rb"\n<f\d+[rv]\d?>", piece)]
            if found:
                return low + found[-1]
            tail, end = piece[1 : 1 + HEADER_BYTES], low
        return None


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^\w+:", path) else (fs.LocalFileSystem(), path)


class TransliterationReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, path = _filesystem(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such path: {self.path}")
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.is_file and f.size and not any(p[:1] in "._" for p in f.path[len(path) :].split("/") if p)]
        return [Split(f.path, a, min(f.size, a + self.split)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.split)] or [Split("", 0, 0)]

    def read(self, part: Split) -> Iterator:
        import pyarrow as pa

        if not part.path:
            return
        store, _ = _filesystem(self.path)
        with store.open_input_file(part.path) as stream:
            rows: list[tuple] = []
            for row in self._rows(Lines(stream, stream.size()), part):
                rows.append(row)
                if len(rows) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types())], names=COLUMNS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types())], names=COLUMNS)

    def _rows(self, lines: Lines, part: Split) -> Iterator[tuple]:
        """A row for each header and variable line (no locus), and for each locus."""
        start = lines.first(part.start)
        if start >= part.end:
            return
        page = folio = None
        before = lines.header_before(start)
        if before is not None:
            page, folio = before, re.match(HEADER, next(lines.between(before, before + 1))[1])[1]
        for at, line in lines.between(start, part.end):
            if not line.strip() or line.startswith("#"):
                continue
            if header := re.match(HEADER, line):
                page, folio = at, header[1]
                yield (part.path, page, at, folio, None, None, *_variables(header[2]))
            elif line.strip().startswith("<!") and folio:
                yield (part.path, page, at, folio, None, None, *_variables(line))
            elif folio and (locus := re.match(LOCUS, line)):
                yield (part.path, page, at, folio, locus[1], locus[2], *(None,) * len(VARIABLES))


def _variables(text: str) -> list:
    found = {name: re.search(rx, text) for name, rx in VARIABLES.items()}
    return [None if m is None else int(m[1]) if name in NUMBERS else m[1] for name, m in found.items()]


COLUMNS = ["file", "page", "offset", "folio", "locus", "raw", *VARIABLES]


def _types() -> list:
    import pyarrow as pa

    return [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *(pa.int64() if v in NUMBERS else pa.string() for v in VARIABLES)]


class TransliterationSource(DataSource):
    """``spark.read.format("transliteration").option("path", ...)``: files that pyarrow's file systems can open; ``splitBytes`` sets the splits."""

    @classmethod
    def name(cls) -> str:
        return "transliteration"

    def schema(self) -> str:
        kinds = ["string", "long", "long", "string", "string", "string", *("long" if v in NUMBERS else "string" for v in VARIABLES)]
        return ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds))

    def reader(self, schema) -> TransliterationReader:
        return TransliterationReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def read_pages(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(file, offset, folio, quire, page_num, language, hand, illustration, cluster, locus, raw): the loci with the variables of their page.

    A variable may stand on any header or comment line of its page, and the last
    one holds for the whole page. Of pages of one name in a file the last one counts. Variables that are not there are null.
    """
    ship_package(spark)
    spark.dataSource.register(TransliterationSource)
    rows = spark.read.format("transliteration").option("path", path).option("splitBytes", str(split_bytes)).load()
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("offset"))).alias(v) for v in VARIABLES]
    pages = rows.where("locus is null").groupBy("file", "page", "folio").agg(*last)
    latest = pages.groupBy("file", "folio").agg(F.max("page").alias("page"))
    pages = pages.join(latest, ["file", "folio", "page"], "left_semi").drop("folio")
    return rows.where("locus is not null").select("file", "page", "offset", "folio", "locus", "raw").join(pages, ["file", "page"]).select("file", "offset", "folio", *VARIABLES, "locus", "raw")


def write_pages(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (folio, the variables, loci: array of locus and text) in the format, in as many files as there are partitions."""
    variables = F.concat_ws(" ", *(F.concat(F.lit(f"${LETTERS[v]}="), F.col(v).cast("string")) for v in VARIABLES))
    loci = F.transform("loci", lambda x: F.concat(F.lit("<"), x["locus"], F.lit("> "), x["text"]))
    head = F.concat(F.lit("<"), F.col("folio"), F.lit("> <! "), variables, F.lit(">"))
    pages.select(F.array_join(F.concat(F.array(head), loci), "\n").alias("value")).write.text(path)
