"""Corpus operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalex.llm import (
    bpe,
    cap_filters,
    chat,
    edit_sketch,
    kneser_ney,
    language_id,
    license_scan,
    packing,
    phrase_dedup,
    simhash_golay,
)
from stratalex.llm.common import Tables, pack_blocks

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, perplexity double, key string"


def texts(seed=0, n=60):
    """Documents with copies, near copies, shared passages, and nulls, blanks and odd signs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    out = [None, "", "  \n\t ", "one", "one two three", "x " * 40, "É\x0b\x85 ﬁ😀 z"]
    for _ in range(n):
        t = " ".join(word() for _ in range(rng.randint(5, 120)))
        if rng.random() < 0.3:
            t = t + "\n" + passage + " " + word()
        if out and rng.random() < 0.3:
            t = rng.choice([x for x in out if x and x.split()])
            if rng.random() < 0.5:
                w = t.split()
                w[rng.randrange(len(w))] = word()
                t = " ".join(w)
        out.append(t)
    return out + ["w" * 5000, " ".join(word() for _ in range(20000))]


def frame(spark, ts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or ""), 1, 2.0, "k") for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def smallest_reachable(linked):
    lab = np.arange(len(linked))
    while True:
        new = np.array([min(lab[i], lab[linked[i]].min() if linked[i].any() else lab[i]) for i in range(len(lab))])
        if (new == lab).all():
            return lab
        lab = new


# 1 --------------------------------------------------------------------------


def test_versions_follow_the_next_smaller_id(spark):
    ts = texts()
    got = {r["doc_id"]: r for r in edit_sketch.compare_versions(frame(spark, ts)).collect()}
    order = list(range(len(ts)))[::-1]
    for k, i in enumerate(order):
        mine, nxt = ts[i] or "", ts[order[(k + 1) % len(order)]] or ""
        third = len(mine) // 3
        want = mine[: len(mine) - third] + nxt[:third]
        assert got[i]["n_chars"] == len(mine) and got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if want == mine:
            assert got[i]["fingerprint"] == got[i]["edited_fingerprint"] and got[i]["near_edited"] == 1
    prints = {}
    for i, t in enumerate(ts):
        assert prints.setdefault(got[i]["fingerprint"], t or "") == (t or "")


def test_versions_of_odd_tables(spark):
    assert edit_sketch.compare_versions(empty(spark)).count() == 0
    one = edit_sketch.compare_versions(frame(spark, ["a b. c d."])).first()
    assert one["near_next"] == 1
    same = edit_sketch.compare_versions(frame(spark, ["a. b.", "a. b.", None], [5, 5, None])).collect()
    assert len(same) == 3


def test_peeling_recovers_the_differences():
    rng = np.random.default_rng(0)
    pools = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (3, 40, 400, 0)]
    other = [np.concatenate((p[: len(p) // 2], rng.integers(0, 2**63, 7).astype(np.uint64))) for p in pools]
    want = [len(set(a.tolist()) ^ set(b.tolist())) for a, b in zip(pools, other)]
    assert edit_sketch.differences(pools, other, 18).tolist() == want
    a, b = edit_sketch.Sketches([pools[1]], 90), edit_sketch.Sketches([other[1]], 90)
    _, keys, signs, whole = a.minus(b, np.array([0]), np.array([0])).peel()
    assert whole[0] and {(k, s) for k, s in zip(keys.tolist(), signs.tolist())} == {(k, 1) for k in set(pools[1].tolist()) - set(other[1].tolist())} | {
        (k, -1) for k in set(other[1].tolist()) - set(pools[1].tolist())
    }


def test_repeated_paragraphs_have_their_own_digests():
    d = edit_sketch.digests("a.\na.\na.\nb.\n")
    assert len(set(d.tolist())) == 4


def brute_paragraphs(t):
    """The paragraphs of a text, sign by sign; words are under 64 bytes."""
    out, word, gap = [""], "", ""
    for c in t:
        if c in " \t\n\x0b\x0c\r":
            gap += c
        else:
            if gap or not word:
                w = word.encode()
                ends = word and (int(phrase_dedup.word_hashes(w, np.array([0]), np.array([len(w)]))[0]) % edit_sketch.WORDS == 0 or "\n" in gap or word[-1] in ".!?|")
                out[-1] += word + gap
                if ends:
                    out.append("")
                word, gap = "", ""
            word += c
    out[-1] += word + gap
    return [p for p in out if p]


def likeness_of(a, b):
    from collections import Counter

    a, b = Counter(brute_paragraphs(a)), Counter(brute_paragraphs(b))
    both = (a | b).total()
    return (a & b).total() / both if both else 1.0


def test_likeness_matches_sets_of_paragraphs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "", ".", "!"])
    ts = [None, "", " \n", "a", "a. a. a.", "a. a. a. a.\n\na."]
    for n in (3, 30, 100, 150, 600, 3000):
        base = [word() for _ in range(n)]
        ts += [rng.choice(" \n").join(base), "  " + " ".join(base[: n // 2] + [word()] + base[n // 2 :]), " ".join(base + base)]
    got = {r["doc_id"]: r for r in edit_sketch.compare_versions(frame(spark, ts)).collect()}
    order = list(range(len(ts)))[::-1]
    for k, i in enumerate(order):
        mine, nxt = ts[i] or "", ts[order[(k + 1) % len(order)]] or ""
        assert b"".join(p.encode() for p in brute_paragraphs(mine)) == mine.encode()
        assert abs(got[i]["near_edited"] - likeness_of(mine, edit_sketch.edited(mine, nxt))) < 1e-12
        assert abs(got[i]["near_next"] - likeness_of(mine, nxt)) < 1e-12


def test_versions_around_any_length_are_cut_alike():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    whole = " ".join(words)
    for n in (590, 595, 599, 600):
        a, b = set(edit_sketch.digests(whole[:n]).tolist()), set(edit_sketch.digests(whole[: n + 20]).tolist())
        assert len(a & b) >= 0.8 * len(a)
    # without white space
    solid = "".join(rng.choice("日本語を話す人々") for _ in range(3000))
    a, b = set(edit_sketch.digests(solid).tolist()), set(edit_sketch.digests(solid[:1500] + "x" + solid[1500:]).tolist())
    assert len(a) > 50 and len(a & b) >= 0.95 * len(a)


# 2 --------------------------------------------------------------------------


def test_license_findings(spark):
    ts = ["Text.\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "The license plate was warranted.",
          "This work is licensed under the GNU General Public License, version 2.", "Licensed under the Apache Licence, Version 2.0.", None, ""]
    got = {(r["doc_id"], r["license"], r["verdict"]) for r in license_scan.scan(frame(spark, ts)).collect()}
    assert got == {(0, "MIT", "exact"), (1, "CC-BY-NC-4.0", "exact"), (2, "CC-BY-4.0", "exact"), (4, "GPL-2.0", "exact"), (5, "Apache-2.0", "variant")}
    row = license_scan.scan(frame(spark, ts)).where("doc_id = 0").first()
    assert ts[0][row["start"] : row["start"] + row["length"]] == "Released under the MIT License."
    assert license_scan.scan(empty(spark)).count() == 0


def test_every_wording_is_found_wrapped_and_amid_text(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    cases = [(name, t) for name, all_ in license_scan.TEMPLATES.items() for t in all_]
    ts = []
    for _, t in cases:
        fill = [word() for _ in range(300)]
        ts.append(" ".join(fill[:150]) + " " + t.replace(" ", "\n", 40) + " " + " ".join(fill[150:]))
    rows = license_scan.scan(frame(spark, ts)).collect()
    got = {(r["doc_id"], r["license"], r["verdict"]): ts[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in rows}
    for i, (name, t) in enumerate(cases):
        assert license_scan.words(got[i, name, "exact"]) == license_scan.words(t)
    two = license_scan.scan(frame(spark, ["Released under the MIT License. x y z Licensed under CC BY 4.0. Released under the MIT License."])).collect()
    assert [r["license"] for r in sorted(two, key=lambda r: r["start"])] == ["MIT", "CC-BY-4.0", "MIT"]


def test_exact_wordings_match_brute_force(spark):
    """Every place where the words of a wording stand in a row, the longest wording of those that overlap."""
    rng = random.Random(8)
    wordings = [(name, license_scan.words(t), t) for name, all_ in license_scan.TEMPLATES.items() for t in all_]
    fill = ["the", "license", "software", "copyright", "rights", "all", "permission", "lorem", "ipsum", "under", "terms", "of"]
    ts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(fill) for _ in range(rng.randint(0, 25))))
            w = rng.choice(wordings)
            parts.append(w[2] if rng.random() < 0.7 else " ".join(w[1][: max(1, len(w[1]) // 3)]))
        ts.append(rng.choice([" ", "\n"]).join(parts))
    rows = license_scan.scan(frame(spark, ts + [None, "", "x" * 50_000 + " MIT"])).where("verdict = 'exact'").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add((r["license"], tuple(license_scan.words(ts[r["doc_id"]][r["start"] : r["start"] + r["length"]]))))
    for i, t in enumerate(ts):
        mine = license_scan.words(t)
        places = [(len(w), a, name) for name, w, _ in wordings for a in range(len(mine) - len(w) + 1) if mine[a : a + len(w)] == w]
        kept = []
        for n, a, name in sorted(places, key=lambda p: (-p[0], p[1], p[2])):
            if all(a + n <= b or b + m <= a for m, b, _ in kept):
                kept.append((n, a, name))
        assert {w for _, w in got.get(i, set())} == {tuple(mine[a : a + n]) for n, a, _ in kept}
        assert {name for name, _ in got.get(i, set())} <= {name for _, _, name in places}


# 3 --------------------------------------------------------------------------


def fingerprint(t):
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x.encode()) for x in words_of(t)]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def test_simhash_components_match_brute_force(spark):
    ts = texts(3, 80)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash_golay.near_duplicates(frame(spark, ts)).collect()}
    f = np.array([fingerprint(t) for t in ts], np.uint64)
    lab = smallest_reachable(np.bitwise_count(f[:, None] ^ f[None]) <= 4)
    assert got == {i: (int(f[i]), int(lab[i])) for i in range(len(ts))}


def test_every_pair_of_four_errors_shares_a_key():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for z in (x, y):
        rows, keys = simhash_golay.keys_of(z)
        pairs = set(zip(rows.tolist(), keys.tolist()))
        assert len(pairs) == len(rows)
        sets.append(pairs)
    assert {r for r, _ in sets[0] & sets[1]} == set(range(len(x)))


def test_dense_buckets_are_linked_without_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 1, dtype=np.uint64)[0]
    fps = np.unique(np.array([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(40) for b in range(a)], np.uint64))
    a, b = simhash_golay.bucket_edges(np.zeros(len(fps), np.int64), fps[:, None], np.arange(len(fps)), 4)
    assert len(a) == len(fps) - 1 and set(a.tolist()) == {0}


def test_simhash_odd_tables(spark):
    assert simhash_golay.near_duplicates(empty(spark)).count() == 0 and simhash_golay.similar_documents(empty(spark)).count() == 0
    got = simhash_golay.near_duplicates(frame(spark, ["a b", "a b", None, ""], [7, 7, None, 3])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(False, 3, 3), (False, 7, 7), (False, 7, 7)]
    alone = simhash_golay.similar_documents(frame(spark, [None, "", "a b c"])).collect()
    assert all(r["doc_id"] == r["component_id"] for r in alone)


def test_similar_documents_find_near_copies_and_leave_others(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    ts = [" ".join(word() for _ in range(200)) for _ in range(20)]
    near = []
    for t in ts[:10]:
        w = t.split()
        w[17] = "zzz"
        near.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in simhash_golay.similar_documents(frame(spark, ts + near)).collect()}
    assert all(got[20 + i] == i for i in range(10)) and all(got[i] == i for i in range(20))


def test_similar_documents_match_brute_force_at_the_threshold(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    ts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(4, 200))]
        ts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            ts.append(" ".join(w))
        if rng.random() < 0.2:
            ts.append(" ".join(base + ["zz"] * 500))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in ts)]
    linked = np.array([[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets])
    near = np.array([[0.6 <= len(a & b) / len(a | b) < 0.8 for b in sets] for a in sets])
    assert near.any() and linked.sum() > len(ts)
    for rows in (2048, 3):
        # small groups: loose groups are dealt in parts
        got = {r["doc_id"]: r["component_id"] for r in simhash_golay.similar_documents(frame(spark, ts), group_rows=rows).collect()}
        assert [got[i] for i in range(len(ts))] == smallest_reachable(linked).tolist()


def test_large_buckets_are_dealt_in_parts(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 30)
    fps = np.unique(np.concatenate([base] + [base ^ (np.int64(1) << np.int64(a)) ^ (np.int64(1) << np.int64(b)) for a, b in ((1, 5), (30, 41), (2, 60), (1, 2))]))
    nodes = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps)], "id long, fp0 long")
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    for bucket in (8192, 2):
        parts = simhash_golay.connected_components(simhash_golay.links(nodes, bucket=bucket)).collect()
        got = {r["node"]: r["component"] for r in parts}
        assert [got.get(i, i) for i in range(len(fps))] == smallest_reachable(near).tolist()


# 4 --------------------------------------------------------------------------


def test_packing_keeps_all_words_and_all_conflicts_apart(spark):
    ts = texts(7, 150)
    rows = packing.pack(frame(spark, ts), capacity=100, per_source=2, block_rows=50).collect()
    where = {}
    for r in rows:
        where.setdefault(r["doc_id"], []).append(r)
    bins = {}
    for i, t in enumerate(ts):
        own = sorted(where[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len((t or "").encode().split())
        for r in own:
            if r["bin"] is not None:
                bins.setdefault(r["bin"], []).append((r["offset"], r["length"], i))
    for items in bins.values():
        items.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(items, items[1:])) and items[0][0] == 0 and items[-1][0] + items[-1][1] <= 100
        same = [b" ".join((ts[i] or "").encode().lower().split()) for _, _, i in items]
        assert len(set(same)) == len(same)
        assert max(np.bincount([i % 3 for _, _, i in items])) <= 2
    assert packing.pack(empty(spark)).count() == 0


def test_equal_rows_are_spread_over_blocks(spark):
    d = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")).repartition(4)
    rows = packing.pack(d, block_rows=100)
    per = rows.groupBy(F.shiftright("bin", 32).alias("block")).count().collect()
    assert len(per) == 20 and max(r["count"] for r in per) < 200
    assert rows.select("bin").distinct().count() == 2000


def test_the_tightest_compatible_bin_is_taken():
    rng = random.Random(1)
    bins, plain = packing.Bins(50, 1), []
    for _ in range(400):
        size, source, cluster = rng.randint(1, 50), rng.randint(0, 6), rng.randint(0, 40)
        fits = [k for k, b in enumerate(plain) if b["room"] >= size and source not in b["s"] and cluster not in b["c"]]
        at, offset = bins.put(size, source, cluster)
        if fits:
            least = min(plain[k]["room"] for k in fits)
            assert at in fits and plain[at]["room"] == least
        else:
            assert at == len(plain)
            plain.append({"room": 50, "s": set(), "c": set()})
        assert offset == 50 - plain[at]["room"]
        plain[at]["room"] -= size
        plain[at]["s"].add(source)
        plain[at]["c"].add(cluster)


# 5 --------------------------------------------------------------------------


def brute_kn(train):
    """Probability function of the same model by its textbook recursion over dictionaries."""
    from collections import Counter

    n = kneser_ney.ORDER
    signs = lambda t: kneser_ney.PAD * (n - 1) + t
    counts = {n: Counter()}
    for t in train:
        s = signs(t)
        counts[n].update(s[i - n + 1 : i + 1] for i in range(n - 1, len(s)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        m = [sum(v == j for v in c.values()) for j in range(1, 5)]
        if min(m) == 0:
            cut[k] = (0.5, 1.0, 1.5)
        else:
            y = m[0] / (m[0] + 2 * m[1])
            cut[k] = tuple(min(max(j - (j + 1) * y * m[j] / m[j - 1], 0.05), j - 0.05) for j in (1, 2, 3))

    def p(g):
        k = len(g)
        if not k:
            return 1 / (1 + len(counts[1]))
        own = {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        d = lambda v: cut[k][min(v, 3) - 1]
        total = sum(own.values())
        c = own.get(g, 0)
        return ((c - d(c)) if c else 0) / total + sum(map(d, own.values())) / total * p(g[1:])

    return lambda t: float(np.exp(-np.mean([np.log(p(s[i - n + 1 : i + 1])) for s in [signs(t)] for i in range(n - 1, len(s))])))


def test_perplexity_matches_the_recursion(spark):
    train = ["The cat sat on the mat.", "A dog, a cat and 7 mats!", "the end\nof the text 小猫\x00\U0001f600", "The cat sat on a hat; the cat", None, ""]
    ask = ["The cat", "zzz $$$", "the mat sat.", "小猫 of the\x00", "\x02\x02T", None, "", "The cat sat on the mat. " * 30]
    tables = Tables(spark)
    for piece in (kneser_ney.PIECE, 7):
        # short pieces: long texts are cut, with what stands before a cut as context
        rows = frame(spark, train + ask)
        blocks = pack_blocks(rows, 200).repartition("block")
        chosen = blocks.mapInArrow(rows_of(len(train)), "block long, row long")
        model, unknown = kneser_ney.fit(kneser_ney.count_grams(blocks, chosen, piece=piece), tables)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        scored = kneser_ney.score(blocks, model, unknown, fields, piece=piece)
        got = {r["doc_id"] - len(train): r["p"] for r in scored.select("doc_id", F.col("_quality.perplexity").alias("p")).collect()}
        brute = brute_kn([t for t in train if t])
        for i, t in enumerate(ask):
            assert got[i] is None if not t else abs(got[i] - brute(t)) < 2e-3 * brute(t)


def rows_of(n):
    """The places (block, row) of the rows with ids under ``n``."""

    def run(batches):
        from stratalex.llm.common import blob_to_table

        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                ids = blob_to_table(blob.as_py()).column("doc_id").to_pylist()
                at = [i for i, x in enumerate(ids) if x < n]
                yield pa.record_batch([pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int64())], names=["block", "row"])

    return run


def test_probabilities_after_a_context_sum_to_one(spark):
    tables, text = Tables(spark), "abab cdcd. abca"
    rows = frame(spark, [text])
    blocks = pack_blocks(rows, 200).repartition("block")
    model, unknown = kneser_ney.fit(kneser_ney.count_grams(blocks, blocks.mapInArrow(rows_of(1), "block long, row long")), tables)
    seen = {(r["gram"], r["weight"]): r["value"] for r in model.collect()}

    def p(context, sign):
        if (context + sign, False) in seen:
            return seen[context + sign, False]
        if not context:
            return unknown
        return seen.get((context, True), 1.0) * p(context[1:], sign)

    for context in ("", "a", "ab", "d. a", "zz"):
        assert abs(sum(p(context, x) for x in [*sorted(set(text)), "unknown"]) - 1) < 1e-9


def test_quality_sees_scrambled_words_of_other_scripts(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(30)]
    clean = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(80)]
    mixed = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()) for t in clean[:10]]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in kneser_ney.classify(frame(spark, clean + mixed), labels).collect()}
    assert all(got[i] for i in range(80)) and not any(got[i] for i in range(80, 90))


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "dog"]) for _ in range(40)) + "." for _ in range(60)]
    junk = ["%$# @!! ^^ ~~ || %% $$ ##" * 4 for _ in range(5)]
    d = frame(spark, clean + junk + [None, ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(60, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in kneser_ney.classify(d, labels).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 67))
    kept = kneser_ney.keep_good(d, labels)
    assert kept.columns == d.columns and kept.count() == 60
    assert kneser_ney.classify(d, labels.limit(0)).where("keep").count() == 67
    assert kneser_ney.classify(empty(spark), labels).count() == 0


# 6 --------------------------------------------------------------------------


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x[100:160] = x[0] + 0.09 * rng.standard_normal((60, 64))
    x[160:200] = x[1]
    for i in range(200, 300):
        x[i] = x[i - 195] + rng.uniform(0.1, 0.3) * rng.standard_normal(64)
    label = [int(v) for v in rng.integers(0, 2, 400)]
    rows = [(i, [float(v) for v in x[i]], label[i], 1.0) for i in range(400)]
    rows += [(400, None, 0, 1.0), (401, [0.0] * 64, 0, 1.0), (402, [float("nan")] + [1.0] * 63, 0, 1.0), (403, rows[0][1], None, 1.0), (404, [], 0, 1.0), (405, [1.0, 2.0], 0, 1.0), (406, [None] + [1.0] * 63, 0, 1.0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, unit double")
    for bucket in (2048, 16):
        got = {r["vec_id"]: r for r in cap_filters.near_duplicates(d, bucket=bucket).collect()}
        u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        link = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
        np.fill_diagonal(link, False)
        found = sum(got[i]["n_links"] for i in range(400))
        assert found >= 0.98 * link.sum() and all(got[i]["n_links"] <= link[i].sum() for i in range(400))
        lab = smallest_reachable(link)
        assert np.mean([got[i]["component_id"] == lab[i] for i in range(400)]) > 0.99
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(400, 407))
    assert cap_filters.near_duplicates(d.limit(0)).count() == 0


def test_vector_recall_just_over_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for dim in (8, 16, 64, 200):
        for label in range(12):
            for _ in range(25):
                x = rng.standard_normal(dim)
                x /= np.linalg.norm(x)
                z = rng.standard_normal(dim)
                z -= z @ x * x
                c = rng.uniform(0.9802, 0.985)
                y = c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows), (x * 3).tolist(), label), (len(rows) + 1, y.tolist(), label)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in cap_filters.near_duplicates(d).collect()}
    assert np.mean([got[b]["component_id"] == a for a, b in pairs]) >= 0.95
    by = {}
    for i, v, label in rows:
        by.setdefault((label, len(v)), []).append((i, np.array(v)))
    for group in by.values():
        u = np.array([v / np.linalg.norm(v) for _, v in group])
        links = (u @ u.T >= 0.98).sum(axis=1) - 1
        assert all(got[i]["n_links"] <= n for (i, _), n in zip(group, links.tolist()))


def test_equal_vectors_and_repeated_rows(spark):
    v = np.random.default_rng(2).standard_normal(32).tolist()
    rows = [(i, v, 1) for i in range(50)] + [(0, v, 1), (60, v, 2), (61, [-x for x in v], 1), (62, [2 * x for x in v], 1)]
    got = {}
    for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert all(got[i] == [(51, 0)] for i in range(1, 50)) and got[0] == [(51, 0)] * 2
    assert got[60] == [(0, 60)] and got[61] == [(0, 61)] and got[62] == [(51, 0)]


# 7 --------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    ts = texts(9, 30) + ["<|endoftext|>", "a<|endoftext|> b", "I'm we've'S  \n\n ", "日本語 テスト", "é" * 300, "!!!!" * 99, "aaaaaaaaaaaaab", "\x00\x01"]
    enc = bpe.encode_documents(frame(spark, ts))
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(enc).collect()}
    dig = {r["doc_id"]: r for r in bpe.round_trip_digests(enc).collect()}
    for i, t in enumerate(ts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == want and back[i] == lib.decode(want, skip_special_tokens=False) == (t or "")
        assert dig[i]["n_tokens"] == len(want) and dig[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode_documents(empty(spark)).count() == 0


# 8 --------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be\\kind <<SYS>>"), (1, 1, "user", said), (1, 2, "assistant", said), (2, 0, "assistant", "first"), (2, 1, "to>ol \\<role ", "x </role> [\\INST]"),
            (3, 0, "user", None), (3, 1, "assistant", ""), (4, 1, "user", "b"), (4, 1, "user", "a"), (None, 0, "user", "<"), (5, None, None, "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("loss", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(d)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, r in got.items():
        mine = [(x[2] or "", x[3] or "") for x in order if x[0] == conv]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["valid"] and got[3]["valid"] and not got[2]["valid"] and not got[4]["valid"]
    assert chat.read_back(chat.format_chats(d.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["[INST]", "\\", "\\[INST]", "[\\INST]", "<<s>", "</s></s>", "<a", "a\\\\</role>b"])
def test_escape_is_reversible_and_hides_marks(text):
    t = chat.Template()
    assert t.unescape(t.escape(text)) == text and not any(c in t.escape(text) for c in t.controls)


# 9 --------------------------------------------------------------------------


def test_languages_are_told_apart(spark):
    rng = random.Random(3)
    sets = {"aa": ["tha", "ing", "her", "and", "ough"], "bb": ["sch", "ung", "keit", "ein", "zu"], "cc": ["eau", "tion", "que", "oui", "ç"]}
    ids, ts, langs = [], [], []
    for i in range(300):
        lang = rng.choice(list(sets))
        ids.append(i)
        langs.append(lang)
        ts.append(" ".join("".join(rng.choice(sets[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 40))))
    rows = [*zip(ids, ts, langs), (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("language", F.lit("x"))
    model = language_id.fit(d, per_language=200)
    got = {r["doc_id"]: r for r in language_id.identify(d, model).select("doc_id", language_id.held_out().alias("h"), "_language.*").collect()}
    test = [i for i in ids if got[i]["h"]]
    assert len(test) > 50 and np.mean([got[i]["lang"] == langs[i] for i in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["lang"] == "und" and got[i]["rejected"] for i in (900, 901, 902))
    assert language_id.identify(d.limit(0), model).count() == 0
    none = language_id.fit(d.limit(0))
    assert {r["lang"] for r in language_id.identify(d, none).select("_language.lang").collect()} == {"und"}


def brute_prediction(model, text):
    """The averaged rows of the table by subword, one at a time, and their softmax."""
    letters = lambda c: c.isalpha()
    own = [bucket for _, part in language_id.subwords([text]) for bucket in part.tolist()]
    if not own or not any(map(letters, text)):
        return "und", 0.0
    z = sum(model.table[b].astype(np.float64) for b in own) / len(own) + model.bias
    e = np.exp(z / model.temperature - (z / model.temperature).max())
    return model.langs[int(e.argmax())], float(e.max() / e.sum())


def test_predictions_match_brute_force_and_long_texts_are_whole(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda a: "".join(rng.choice(a) for _ in range(5))
    model = language_id.train([(a[:2], " ".join(word(a) for _ in range(30))) for a in ("abcdef", "ghijkl", "éüßопр") for _ in range(30)])
    ts = [" ".join(word(rng.choice(["abcdef", "ghijkl", "éüßопр", "123"])) for _ in range(rng.randint(1, 50))) for _ in range(40)] + ["", "12 3", "a"]
    lang, score = model.predict(ts)
    for t, name, p in zip(ts, lang, score.tolist()):
        want, prob = brute_prediction(model, t)
        assert name == want and abs(p - prob) < 1e-6
    monkeypatch.setattr(language_id, "LONG", 37)
    again, cut = model.predict(ts)
    assert again == lang and np.abs(cut - score).max() < 0.02
    assert all("".join(language_id.cut_long(t)) == t for t in ts)
    d = frame(spark, ["a"]).withColumn("_language", F.lit(1))
    with pytest.raises(ValueError):
        language_id.identify(d, model)
    assert language_id.identify(d, model, into="found").first()["_language"] == 1


# 10 -------------------------------------------------------------------------


def brute_repeats(ts, ids):
    first = {}
    for i, t in zip(ids, ts):
        w = words_of(t)
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in zip(ids, ts):
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [2 << 20, 3000])
def test_repeated_passages_match_brute_force(spark, block):
    ts = texts(11, 90)
    clean = phrase_dedup.remove_repeats(frame(spark, ts), block_bytes=block)
    assert clean.columns == [*frame(spark, ts).columns, "_dedup"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrase_dedup.kept_words_digest(clean).collect()}
    want = brute_repeats(ts, range(len(ts)))
    assert sum(v[1] for v in want.values()) > 500 and got == want


def test_unequal_long_words_are_not_taken_for_equal(spark):
    # a sequence and its complement have equal polynomial hashes modulo 2**64
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    tail = " ".join(f"w{i}" for i in range(12))
    got = phrase_dedup.remove_repeats(frame(spark, [f"{a} {tail}", f"{b} {tail}"])).select("_dedup.n_removed").collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_automata_compare_words_and_not_hashes(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "word_hashes", lambda data, start, end: np.ones(len(start), np.uint64))
    monkeypatch.setattr(phrase_dedup, "SHARD_PHRASES", 2)
    phrase = [f"w{i}" for i in range(13)]
    ts = [" ".join(["x", *phrase, "y"]), " ".join(["x", *phrase[:12], "v", "y"])]
    words = phrase_dedup.Words([t.encode() for t in ts])
    told = [" ".join(phrase).encode(), " ".join(["z"] * 13).encode(), " ".join(phrase[::-1]).encode()]
    gone = phrase_dedup.occurrences(words, np.array([8, 9]), np.array([True, True]), told, [3, 3, 3])
    assert gone.tolist() == [False, *[True] * 13, False] + [False] * 15
    assert not phrase_dedup.occurrences(words, np.array([3, 2]), np.array([True, True]), told, [3, 3, 3]).any()


def test_a_text_of_very_many_words_is_whole(spark):
    long = " ".join(f"q{i}" for i in range(400_000))
    ts = [long, "a b " + " ".join(f"q{i}" for i in range(399_950, 400_000)), long + " tail"]
    got = {r["doc_id"]: r["n_removed"] for r in phrase_dedup.remove_repeats(frame(spark, ts), block_bytes=1 << 20).select("doc_id", "_dedup.n_removed").collect()}
    assert got == {0: 0, 1: 50, 2: 400_000}


def test_word_hashes_of_any_length():
    ws = [b"w" * n for n in range(1, 90)] + [b"\x00" * n for n in range(1, 90)] + [("é" * n).encode() for n in range(1, 60)]
    data = b" ".join(ws)
    from stratalex.llm.common import word_hashes, word_places

    start, end = word_places(data)
    h = word_hashes(data, start, end)
    assert len(set(h.tolist())) == len(set(ws))
    other = b"  ".join(reversed(ws))
    assert sorted(word_hashes(other, *word_places(other)).tolist()) == sorted(h.tolist())


def test_repeats_with_a_clashing_column(spark):
    d = frame(spark, ["a b"]).withColumn("_dedup", F.lit(1)).withColumn("odd`name", F.lit(2))
    with pytest.raises(ValueError):
        phrase_dedup.remove_repeats(d)
    row = phrase_dedup.remove_repeats(d, into="again").first()
    assert row["_dedup"] == 1 and row["odd`name"] == 2 and row["again"]["n_words"] == 2


def test_repeats_with_equal_and_missing_ids(spark):
    t = " ".join(f"w{i}" for i in range(20))
    got = phrase_dedup.remove_repeats(frame(spark, [t, t, t, t], [4, 4, None, 9])).select("doc_id", "_dedup.n_removed").collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (4, 0), (4, 0), (9, 20)]
    assert phrase_dedup.remove_repeats(empty(spark)).count() == 0


def test_blocks_hold_whole_rows():
    from stratalex.llm.common import blob_to_table, table_to_blob

    t = pa.table({"a": pa.array([1, None, 3]), "b": pa.array(["x", None, "é"])})
    assert blob_to_table(table_to_blob(t.slice(1, 2))).to_pylist() == t.slice(1, 2).to_pylist()
