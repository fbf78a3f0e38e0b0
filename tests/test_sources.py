"""Readers, writers and streams."""

import json

from pyspark.sql import functions as F

from stratalex.sources import readers as rd
from stratalex.streaming import events as ev


PAGES = [
    "#=IVTFF head", "noise before", "<f0r.1> before any page", "<f1r>  <! $Q=3 $L=B $H=2 $I=T>", "<f1r.P1.1;H> fa[ch:sh]ys.{ykal}<!note>.Ar-", "# c <f9r>", "<f1r.L1.2;H> dain?*,",
    "  <! $C=9x $P=7 $L=A>", "", "<f2v>", "<f2v.1,@P0> okal=", "noise", "<f2v.Q> qo<->dy<$>", " <f3r>", "<f4r1> $Q=12", "<f4r1.X9> a@1;b", "<f4r1.C> \u00e9c", "<f2v> $I=H", "<f2v.T1> only.this", "<f5v2>",
]


def one_by_one(text):
    """Pages of a file by a loop over all lines: folio -> (variables, loci)."""
    import re

    from stratalex.sources.transliteration import HEADER, LOCUS, NUMBERS, VARIABLES

    pages, own = {}, None
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line.strip() or line.startswith("#"):
            continue
        if m := re.match(HEADER, line):
            own = pages[m[1]] = (dict.fromkeys(VARIABLES), [])
            line = m[2]
        elif not (line.strip().startswith("<!") and own):
            if own and (m := re.match(LOCUS, line)):
                own[1].append((m[1], m[2]))
            continue
        for name, rx in VARIABLES.items():
            if m := re.search(rx, line):
                own[0][name] = int(m[1]) if name in NUMBERS else m[1]
    return {(f, *v.values(), *x) for f, (v, loci) in pages.items() for x in loci}


def test_pages_are_the_same_wherever_files_are_cut(spark, tmp_path):
    from stratalex.sources.transliteration import VARIABLES, read_pages

    texts = ["\n".join(PAGES), "\r\n".join(PAGES[3:]) + "\n", "\n".join(f"<f{i}r> $H={i}\n" + f"<f{i}r.P1;H> x\n" * (i % 4) for i in range(40)), "<f1r>", "\n\n", "no page at all"]
    want = set()
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
        want |= {(f"{i}.txt", *r) for r in one_by_one(t)}
    (tmp_path / "_hidden").write_text("<f1r>\n<f1r.P1> x")
    for size in (40, 1 << 20):
        rows = read_pages(spark, str(tmp_path), size).collect()
        have = {(r.file.rpartition("/")[2], r.folio, *(r[v] for v in VARIABLES), r.locus, r.raw) for r in rows}
        assert have == want, size


def test_a_header_far_back(tmp_path, monkeypatch):
    import io

    from stratalex.sources import transliteration as tr

    monkeypatch.setattr(tr, "PIECE", 16)
    text = b"<f12r> a\n" + b"<f12r.P1> word\n" * 50 + b"<f345v2> $Q=1\n" + b"<x> y\n" * 30
    lines = tr.Lines(io.BytesIO(text), len(text))
    second = text.index(b"<f345")
    for at in range(len(text) + 1):
        start = lines.first(at)
        assert start == len(text) or start == 0 or text[start - 1 : start] == b"\n"
        assert lines.header_before(start) == (None if start == 0 else 0 if start <= second else second)
    assert [x for _, x in lines.between(0, len(text))] == text.decode().split("\n")[:-1]


def test_transliteration(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(PAGES))
    rows = rd.read_transliteration(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["folio"], r["language"], r["hand"], r["kind"], r["text"]) for r in rows] == [
        ("f1r", "A", 2, "P", "fachys ykal ar"), ("f1r", "A", 2, "L", "dain"), ("f4r1", None, None, "X", "ab"), ("f4r1", None, None, "C", "c"), ("f2v", None, None, "T", "only this"),
    ]
    kinds = spark.createDataFrame([("f1r.P1.1;H",), ("f1r.Q",), ("f1r.1,@P0",), ("f1r.Z.L2",)], "l string")
    assert [r[0] for r in kinds.select(rd.locus_type(F.col("l"))).collect()] == ["P", "Q", "P", "L"]


def test_lists_names_and_tiles(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"A": ["x", "y"], "B": []}))
    assert sorted(map(tuple, rd.read_word_lists(spark, str(tmp_path / "d.json")).collect())) == [("A", "x"), ("A", "y")]
    (tmp_path / "n.csv").write_text('Species,Names\nRosa gallica,"Rosa (red), Rosae"\n')
    assert sorted(map(tuple, rd.read_species_names(spark, str(tmp_path / "n.csv")).collect())) == [("Rosa gallica", "rosa"), ("Rosa gallica", "rosae")]
    (tmp_path / "t.txt").write_text("a b c")
    assert [r["tok"] for r in rd.tiled_tokens(spark, str(tmp_path / "t.txt"), 5).orderBy("pos").collect()] == list("abcab")


def test_synthetic_is_the_same_each_time(spark):
    a = [r["text"] for r in rd.synthetic_sentences(spark, ["u", "v", "w"], 5).orderBy("id").collect()]
    assert a == [r["text"] for r in rd.synthetic_sentences(spark, ["u", "v", "w"], 5).repartition(3).orderBy("id").collect()]


def test_a_templated_corpus_ends_at_its_size(spark):
    rows = rd.templated_corpus(spark, ["x {a} y", "{a} {b}"], {"a": ["p", "q"], "b": ["r"]}, 10_000).collect()
    n = sum(len(r["text"].split()) for r in rows)
    assert 10_000 <= n < 10_003 and sorted(r["id"] for r in rows) == list(range(len(rows)))
    assert {w for r in rows for w in r["text"].split()} == {"x", "y", "p", "q", "r"}


def test_missing_paths_are_errors(spark, tmp_path):
    import pytest
    for read in (rd.read_folio_lines, rd.read_transliteration):
        with pytest.raises(Exception, match="nothing"):
            read(spark, str(tmp_path / "nothing")).count()


def test_tables_of_stages_go(spark):
    import os

    from stratalex.session import Tables, checkpointed

    tables = Tables(spark)
    assert tables.put(spark.range(3), "x").count() == 3
    path = tables.paths[0].removeprefix("file:")
    assert os.path.isdir(path)
    tables.drop()
    assert not os.path.exists(path)
    kept = checkpointed(spark.range(100).repartition(5, "id"))
    plan = kept.groupBy("id").count()._jdf.queryExecution().toString()
    assert kept.count() == 100 and "Exchange hashpartitioning(id" not in plan


def test_results_and_stage_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    p = str(tmp_path / "stage")
    assert rd.stage_cache(spark, p, make).count() == 3 and rd.stage_cache(spark, p, make).count() == 3 and made == [1]
    rd.write_result(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_counts_like_a_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:00:00", i % 2, "click" if i % 2 else "view", 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = ev.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, ev.tumbling(df).collect()))
    assert ev.sessions(df).agg(F.sum("n")).first()[0] == 12
