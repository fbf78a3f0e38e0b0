"""Suffix arrays and the removal of recurring strings, against plain searches."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalex.llm import suffix_dedup as sd
from stratalex.llm.suffix_array import BlindTrie, lanes, multikey_quicksort, recurring_offsets, suffix_array


def near(rng, n, size):
    """Strings of few letters with long common beginnings, some equal, some with zeros at their ends."""
    base = [bytes(rng.choices(b"ab\x00\xff", k=size)) for _ in range(4)]
    out = []
    for _ in range(n):
        s = bytearray(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            s[rng.randrange(size)] = rng.choice(b"abc\x00")
        out.append(bytes(s[: rng.randint(0, size)]))
    return out


@pytest.mark.parametrize("shallow", [8, 24, 96])
def test_order_and_common_bytes(shallow):
    rng, width = random.Random(shallow), 64
    strings = near(rng, 600, width)
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    group = np.sort(np.array([rng.randint(0, 9) for _ in strings]))
    for back in (False, True):
        start = np.cumsum(size) - (0 if back else size)
        rows = lanes(data, start, size, width, back)
        full = [(s[::-1] if back else s).ljust(width, b"\0") for s in strings]
        assert [r.astype(">u8").tobytes() for r in rows] == full
        order, same = suffix_array(rows, group, shallow)
        assert sorted(order.tolist()) == list(range(600)) and (group[order] == group).all()
        assert [(group[i], full[i]) for i in order] == sorted((group[i], s) for i, s in enumerate(full))
        for k in range(1, 600):
            a, b = full[order[k - 1]], full[order[k]]
            want = -1 if group[k - 1] != group[k] else next((i for i in range(width) if a[i] != b[i]), width)
            assert same[k] == want


def test_quicksort_leaves_equal_beginnings_to_the_tries():
    rows = np.array([[3, 2], [1, 9], [3, 1], [1, 9], [0, 0]], np.uint64)
    order, deep = multikey_quicksort(rows, np.zeros(5, np.int64), 1)
    assert order[0] == 4 and sorted(map(tuple, deep)) == [(1, 2), (3, 4)]
    trie = BlindTrie([b"ab", b"aa", b"ab", b"b\0", b"aa"])
    assert trie.sorted() == [1, 4, 0, 2, 3]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=9), st.text("ab", max_size=12), st.integers(0, 2), st.integers(1, 2)), max_size=14), st.integers(0, 3), st.integers(0, 9))
def test_offsets_of_windows_that_recur(places, low, high):
    least = 8
    places = sorted(set(places), key=lambda p: p[2])
    places = [p for i, p in enumerate(places) if (p[0], p[1], p[2]) not in {q[:3] for q in places[:i]}]
    data, start = b"", []
    for a, b, _, _ in places:
        start.append(len(data) + len(a))
        data += (a + b).encode()
    n = len(places)
    args = [np.array([len(p[k]) for p in places], np.int64) for k in (0, 1)] + [np.array([p[k] for p in places], np.int64) for k in (2, 3)]
    got = recurring_offsets(np.frombuffer(data, np.uint8), np.array(start, np.int64), *args, np.full(n, low), np.full(n, high), least, 8)
    for i, (a, b, g, times) in enumerate(places):
        windows = {o: a[len(a) - o :] + b[: least - o] for o in range(low, min(high, least, len(a)) + 1) if len(b) >= least - o}
        hits = [o for o, w in windows.items() if times > 1 or any(h == g and o <= len(x) and len(y) >= least - o and x[len(x) - o :] + y[: least - o] == w for j, (x, y, h, _) in enumerate(places) if j != i)]
        assert (got[0][i], got[1][i]) == ((min(hits), max(hits)) if hits else (-1, -1))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    for least in (8, 20, 64, 200):
        passage = bytes(rng.choices(b"abcdefgh", k=least))
        texts = [bytes(rng.choices(b"abcdefgh", k=rng.randint(0, 3 * least))) for _ in range(4)]
        one, two = texts[0] + passage + texts[1], b"x" + texts[2] + passage + texts[3]
        places = []
        for t in (one, two):
            at, gram = sd.anchors(np.frombuffer(t, np.uint8), np.array([len(t)]), least)
            begin = t.index(passage)
            here = [(int(p) - begin, int(g)) for p, g in zip(at, gram) if begin <= p <= begin + least - sd.gram_size(least)]
            places.append(set(here))
        assert places[0] & places[1]


def plain(texts, least):
    """(kept, n_removed, n_spans) of texts in bytes, by all windows."""
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - least + 1):
            seen.setdefault(t[p : p + least], []).append((k, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + least] = b"\1" * least
    out = []
    for t, g in zip(texts, gone):
        out.append((bytes(c for c, x in zip(t, g) if not x), sum(g), sum(x and not y for x, y in zip(g, b"\0" + bytes(g)))))
    return out


def documents(rng, least, n):
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(least // 2, 3 * least))) for _ in range(6)]
    texts = ["", None, "a" * (5 * least), "ab" * (3 * least), "é" * least, "é" * least + "x", "z" * (least - 1), "a"]
    for _ in range(n):
        t = "".join(rng.choice([rng.choice(passages), "".join(rng.choices("abcdefghé\n", k=rng.randint(0, 2 * least)))]) for _ in range(rng.randint(0, 4)))
        texts.append(t)
        if rng.random() < 0.3:
            texts.append(t)
        if rng.random() < 0.3 and t:
            cut = rng.randrange(len(t))
            texts.append(t[:cut] + "#" + t[cut + 1 :])
    # one short phrase with many different surroundings, and one just long enough
    phrase = "".join(rng.choices("pqrstu", k=least - 3))
    texts += ["".join(rng.choices("klmno", k=least)) + phrase + "".join(rng.choices("klmno", k=least)) for _ in range(60)]
    texts += [rng.choice("klmno") * rng.randint(0, 3) + phrase + "xyz" + "".join(rng.choices("klmno", k=least)) for _ in range(30)]
    return texts


@pytest.mark.parametrize("least, part, block", [(20, 1024, 2 << 20), (20, 4, 700), (64, 8, 5000)])
def test_removal(spark, least, part, block):
    rng = random.Random(least + part)
    texts = documents(rng, least, 60)
    docs = spark.createDataFrame([(i % 90 or None, t, f"k{i}", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, `n_bytes` int").repartition(3)
    got = sd.remove_recurring(docs, least=least, part=part, block_bytes=block)
    assert got.columns == ["doc_id", "text", "kept", "n_bytes", "_dedup"]
    have = {r.n_bytes: r for r in got.collect()}
    assert len(have) == len(texts)
    for i, (t, (kept, removed, spans)) in enumerate(zip(texts, plain([(t or "").encode() for t in texts], least))):
        r = have[i]
        assert (r.text, r.kept) == (t, f"k{i}")
        assert (bytes(r._dedup.kept), r._dedup.n_removed, len(r._dedup.spans)) == (kept, removed, spans), (i, t)
        assert r._dedup.n_bytes == len((t or "").encode()) and sum(s.size for s in r._dedup.spans) == removed
    out = {r.kept_sha256 for r in sd.kept_digest(got.where("n_bytes = 0")).collect()}
    assert out == {hashlib.sha256(b"").hexdigest()}


def test_empty_and_refused(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "abc")], "doc_id long, text string")
    assert sorted(sd.kept_digest(sd.remove_recurring(docs)).select("n_bytes", "n_removed", "n_spans").collect()) == [(0, 0, 0), (0, 0, 0), (3, 0, 0)]
    assert sd.remove_recurring(docs.limit(0)).count() == 0
    for bad in ({"into": "text"}, {"least": 4}):
        with pytest.raises(ValueError):
            sd.remove_recurring(docs, **bad)
