"""Fill-in-middle: ranks, forms and restored texts, against plain slices and on odd rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalex.llm import fill_middle as fm


def plain(text, ident):
    """By an array of all units."""
    h = hashlib.sha256(f"1:{ident}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", a, b - a) if h[3] % 100 < 20 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", a, b - a)


TEXTS = ["", "a", "é\n\r\x00𝄞", "x<P>y", "<S>", "<<P", "><M", "P>S>M>", "ab " * 5000, "𝄞é" * 9001, "<", ">", "<P", "a" * 4096, "b" * 4097]


@pytest.mark.parametrize("text", TEXTS)
def test_slices(text):
    matcher = fm.Matcher()
    for ident in range(60):
        assert fm.transformed(text, ident, 1, matcher, fm.Layout()) == plain(text, ident)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSM aé\n", max_size=40), st.integers(-5, 10**12))
def test_any_text(text, ident):
    assert fm.transformed(text, ident, 1, fm.Matcher(), fm.Layout()) == plain(text, ident)


def test_words_as_units():
    unit = r"(?s:[^ ]+ ?| )"
    matcher, text = fm.Matcher(unit), "one two  three " * 400
    import re

    ends = [0, *(m.end() for m in re.finditer(unit, text))]
    assert matcher.count(text) == len(ends) - 1
    for a, b in ((0, 0), (1, 17), (300, 301), (len(ends) - 1, len(ends) - 1)):
        assert matcher.places(text, a, b) == (ends[a], ends[b])
    with pytest.raises(ValueError):
        fm.Matcher("[a-z]").count("ab c")
    with pytest.raises(ValueError):
        fm.Matcher("[a-z]*")


def test_marks_that_cannot_be_told_apart():
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fm.Layout(*marks)


def test_rows(spark):
    rows = [(i % 17, t, f"s{i}", i) for i, t in enumerate(TEXTS * 3)] + [(None, "text of none", None, 1), (5, None, "x", 2), (5, None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n` string, `form.x` int")
    made = fm.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "form.x", "_fim"]
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(r.text or "", "" if r.doc_id is None else r.doc_id)
        assert tuple(r._fim) == want
    for r in made.select("text", fm.restored(made["_fim.output"], made["_fim.form"]).alias("again")).collect():
        assert r.again == (r.text or "")
    out = fm.digests(made)
    assert {r.restored_sha256 for r in out.collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows}
    assert fm.digests(fm.transform(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        fm.transform(docs.withColumnRenamed("form.x", "_fim"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
