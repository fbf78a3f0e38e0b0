"""Steps that once grew faster than their input, and rows that once differed from their SQL at larger tables."""

import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np

from stratalex.operators import matching as m
from stratalex.operators import automata, decode, factors, generative, grammar, nulls, search, stats, syllables
from stratalex.plans import matching, statistics
from stratalex.plans.catalog import ORACLES, QUERIES

LARGER = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def planned(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_word_kinds_are_those_of_sql_to_the_last_digit(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{LARGER}/documents.parquet'")
    cols = "tok, c, functional, content, kind"
    want = con.execute(f"select {cols} from ({ORACLES['functional_content_score']})").fetchall()
    assert {tuple(r) for r in QUERIES["functional_content_score"](spark, LARGER).selectExpr(*cols.split(", ")).collect()} == set(want)


def test_trigrams_are_sent_to_the_words_and_not_the_other_way(spark):
    words = spark.createDataFrame([("abc", 2), ("abd", 1)], "word string, freq long")
    asked = spark.createDataFrame([("abc",), ("xyz",)], "tok string")
    plan = matching.char_scores(words, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan.split("Aggregate [tok", 1)[1].split("\n")[2]


def test_known_pairs_give_the_scores_of_all_candidates(spark):
    rng = random.Random(3)
    words = [a + b for a in "abc" for b in "xyz"]
    index = spark.createDataFrame([("K" if w[0] == "a" else "L", w, 1) for w in words], "skel string, word string, freq long")
    bigrams = spark.createDataFrame([(a, b, rng.random()) for a in words for b in words if rng.random() < 0.3], "w1 string, w2 string, p double")
    rows = [(i, "t" + k, k, rng.choice([None, *words]), rng.choice([None, *words])) for i in range(300) for k in [rng.choice("KLM")]]
    open_ = spark.createDataFrame(rows, "pos long, tok string, skel string, left string, right string")
    all_ = m.context_scores(open_, m.exact_matches(open_.select("tok", "skel").distinct(), index), bigrams).where("score > 0")
    want = {(r["left"], r["tok"], r["right"]): (r["word"], r["score"], r["second"], r["nonzero"]) for r in all_.collect()}
    likely = m.likely(open_, index, bigrams)
    got = {(r["left"], r["tok"], r["right"]): (r["word"], r["score"], r["second"], r["nonzero"]) for r in likely.collect()}
    assert got == want and len(want) > 50
    # open tokens are not moved to be grouped by context
    assert "Window" not in likely._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_text_of_equal_states_is_read_in_time(spark):
    """Ties were told apart by whole texts: the square of a text's length."""
    rng = random.Random(1)
    after = {s: {t: 0.2 for t in ("ka", "to", "e", syllables.SPACE)} for s in ("ka", "to", "e", syllables.SPACE)}
    tokens = ["".join(rng.choices("ab", k=3)) for _ in range(20_000)]
    began = time.time()
    text, _ = syllables.decode(tokens, after, {"a": ["ka", "e"], "b": ["to", "ri"], "": ["", "k"]})
    assert text and time.time() - began < 30


def test_ends_of_states_are_in_the_order_of_their_texts():
    common = (None, "ab")
    states = [((common, "b"), "a"), ((common, "a"), "z"), ((common, "a"), "")]
    whole = [syllables._spelled(x) for x in states]
    ends = syllables._endings(states)
    assert ["ab" + x for x in ends] == whole and syllables._endings(states[:1]) == [""]


def test_trials_are_counted_a_row_a_type(spark):
    plan = planned(spark, "gradient_permutation")
    assert "trial" not in plan[plan.rindex("Aggregate [tok#") :]


def test_words_dealt_anew_are_moved_once(spark):
    assert "Join Inner, ((b#" not in planned(spark, "cross_document_shuffle")


def test_name_kinds_of_repeated_rows(spark, tmp_path):
    con = duckdb.connect()
    for t, rows in (("documents", "SELECT * FROM t UNION ALL SELECT * FROM t WHERE doc_id % 3 = 0"), ("benchmark", "SELECT * FROM t")):
        con.execute(f"copy (WITH t AS (SELECT * FROM '{SMALL}/{t}.parquet') {rows}) to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.execute(f"select kind, docs from ({ORACLES['name_match_kinds']})").fetchall()
    assert sorted(map(tuple, QUERIES["name_match_kinds"](spark, str(tmp_path)).select("kind", "docs").collect())) == sorted(want)


def test_candidates_that_no_pair_knows_are_ranked_once_a_prefix():
    rng = random.Random(5)
    words = ["ab" + x + y for x in "abcdef" for y in "abcdef"]
    sentences = [rng.choices(words[:20], k=30) for _ in range(20)]
    model, index = decode.TrigramModel(sentences), {"ab": words}
    whole, short = decode.Ranker(model, index), decode.Ranker(model, index, 5)
    for a in words[:22]:
        for b in words[:22]:
            want = sorted((-decode.math.log(model.p(a, b, c)), c) for c in words)
            assert whole(a, b, "abz") == want and short(a, b, "abz")[:5] == want[:5]
    # words before that are in no pair share one list
    assert whole("", "zz", "ab") is whole("", "zzz", "ab")


def test_a_token_that_comes_again_is_taken_apart_once(monkeypatch):
    calls, real = [], decode.branching_skeletons
    monkeypatch.setattr(decode, "branching_skeletons", lambda *a: calls.append(a) or real(*a))
    decoder = decode.BudgetedDecoder([("K-L", "kal", 0.1), ("K-L", "kel", 0.2)])
    first = decoder.decode(["kol", "kal"] * 50)
    assert len(calls) == 2 and decoder.decode(["kol", "kal"] * 50) == first and len(calls) == 2


def test_orders_of_documents_meet_known_pairs_without_a_join(spark):
    plan = planned(spark, "shuffle_null_pvalue")
    assert "MapInArrow" in plan and "Join" not in plan


def test_orders_are_the_same_however_many_are_held(spark):
    rng = random.Random(4)
    words = rng.choices("abcdefgh", k=300)
    pairs = [("a", "b"), ("c", "a"), ("d", "d"), ("e", "zz")]
    one, many = nulls.permuted_hits(words, pairs, 60, [1], cells=1), nulls.permuted_hits(words, pairs, 60, [1], cells=1 << 18)
    assert one[0] == many[0] and one[1].tolist() == many[1].tolist()
    # numbers of a whole table's words give what the words give
    docs = spark.createDataFrame([(7, words), (None, words), (8, ["q", "r"])], "doc_id long, toks array<string>")
    known = spark.createDataFrame(pairs, "w1 string, w2 string")
    got = {r["doc_id"]: (r["hits"], r["null_mean"]) for r in nulls.shuffle_null(docs, known, 60).collect()}
    real, null = nulls.permuted_hits(words, pairs[:3], 60, [42, 7])
    assert got == {7: (real, null.mean()), None: (0, 0.0), 8: (0, 0.0)}


def test_expected_pairs_move_a_row_a_document(spark):
    assert "Join" not in planned(spark, "pair_null_expectation")
    rng = random.Random(9)
    rows = [(i % 30, rng.choices("abcde", k=rng.randint(2, 40))) for i in range(40)]
    pairs = [(a, b) for a in "abcz" for b in "abd"]
    got = nulls.pair_expectation(spark.createDataFrame(rows, "doc_id long, toks array<string>"), spark.createDataFrame(pairs, "w1 string, w2 string"))
    want = []
    for i, toks in rows:
        own = [t for j, t in rows if j == i]
        c = Counter(w for t in own for w in t)
        want.append((i, len(toks), sum((a, b) in pairs for t in own for a, b in zip(t, t[1:])), sum(c[a] * (c[b] - (a == b)) for a, b in pairs)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_words_of_a_grammar_are_spelled_in_time():
    """Each word once made all tables of the grammar anew: some milliseconds a word."""
    g = grammar.Grammar(list(grammar.SHAPE), {s: np.random.default_rng(2).random(26) for s in grammar.SPENDERS})
    one, many = np.random.default_rng([1, 5]), grammar.drawn(np.random.default_rng([1, 5]), 7).__next__
    word = grammar.speller(g)
    assert [grammar.spell(g, one) for _ in range(50)] == [word(many) for _ in range(50)]
    # the draws are those of numpy's own choice
    rng, p = np.random.default_rng(3), np.array([0.4, 0.3, 0.2, 0.1])
    upto = (p.cumsum() / p.cumsum()[-1]).tolist()
    assert [int(rng.choice(4, p=p)) for _ in range(200)] == [grammar.bisect_right(upto, u) for u in np.random.default_rng(3).random(200)]
    began = time.time()
    assert len([word(many) for _ in range(20_000)]) == 20_000 and time.time() - began < 10


def test_letters_of_messages_are_written_once_a_word(monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(25)]
    for _ in range(20):
        after = {w: rng.sample(words, rng.choice([1, 1, 2, 2])) for w in words if rng.random() < 0.9}
        carrier, start = search.Carrier(after), sorted(w for w, n in after.items() if len(n) > 1)
        for _ in range(10):
            text, i = "".join(rng.choices("abcxyz", k=rng.randint(0, 40))), rng.randint(-50, 50)
            bits = [int(b) for c in text for b in f"{ord(c):08b}"]
            written = search.carry(bits, after, start[i % len(start) :] + start[: i % len(start)])
            assert carrier.write(text, i) == (len(bits), len(written), search.carried_bits(written, after)[: len(bits)] == bits)
    calls, real = [], search.carried_bits
    monkeypatch.setattr(search, "carried_bits", lambda *a: calls.append(a) or real(*a))
    search.Carrier({"a": ["a", "b"], "b": ["b", "a"]}).write("xyz" * 1000, 0)
    assert 0 < len(calls) < 20


def test_borders_of_words_do_not_move_words(spark):
    for name in ("boundary_mi", "strong_boundaries"):
        assert "w2" not in "".join(line for line in planned(spark, name).splitlines() if "Aggregate [" in line)


def test_letters_of_documents_are_counted_in_their_rows(spark):
    rng = random.Random(6)
    rows = [(i % 20, "s", "".join(rng.choices("abcz", k=rng.choice([1, 2, 30])))) for i in range(30)]
    got = stats.letter_entropies(spark.createDataFrame(rows, "doc_id long, source string, letters string"), "doc_id", "source")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    h = lambda c: -sum(n / sum(c.values()) * np.log2(n / sum(c.values())) for n in c.values())
    for r in got.collect():
        own = [x for i, _, x in rows if i == r["doc_id"]]
        pairs = Counter(p for x in own for p in zip(x, x[1:]))
        first = Counter(a for x in own for a in x[:-1])
        assert abs(r["h1"] - h(Counter("".join(own)))) < 1e-9 and abs(r["h2"] - (h(pairs) - h(first) if pairs else 0)) < 1e-9
    assert got.count() == 20


def test_surprisals_are_of_pairs_and_not_of_documents(spark):
    docs = spark.createDataFrame([(1, "a b a b c".split()), (2, "a c".split()), (3, ["c"]), (4, [])], "doc_id long, toks array<string>")
    got = {(r["w1"], r["w2"]): (r["c"], r["s"]) for r in statistics.surprisals(docs).collect()}
    want = {("a", "b"): (2, -np.log2(2 / 3)), ("b", "a"): (1, -np.log2(3 / 8)), ("b", "c"): (1, -np.log2(3 / 8)), ("a", "c"): (1, -np.log2(3 / 8))}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - s) < 1e-12 for k, (n, s) in want.items())


def test_profiles_of_languages_are_made_once(spark):
    for name in ("codebook_compatibility", "constraint_check"):
        assert not [f for f in QUERIES[name](spark, SMALL).inputFiles() if "documents" in f]


def test_likeness_needs_no_minimal_states_and_reads_words_once(spark, monkeypatch):
    monkeypatch.setattr(automata, "minimise", lambda *a: 1 / 0)
    got = QUERIES["automaton_likeness"](spark, SMALL)
    assert not [f for f in got.inputFiles() if "documents" in f] and got.count() > 0


def test_pairs_near_each_other_are_made_of_listed_words_only(spark):
    rng = random.Random(8)
    docs = [(rng.choices("abcdefgh", k=rng.randint(0, 25)),) for _ in range(30)] + [(None,)]
    words = spark.createDataFrame([("a", 0), ("c", 1), ("d", 2)], "tok string, i int")
    got = factors.cooccurrence(spark.createDataFrame(docs, "toks array<string>"), words, 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    number, want = {"a": 0, "c": 1, "d": 2}, Counter()
    for (t,) in docs[:-1]:
        for i, x in enumerate(t):
            for y in t[i + 1 : i + 4]:
                if x in number and y in number:
                    want[number[x], number[y]] += 1
                    want[number[y], number[x]] += 1
    assert {(r["i"], r["j"]): r["x"] for r in got.collect()} == want


def test_open_words_find_their_neighbours_in_the_row(spark):
    rng = random.Random(2)
    docs = [(i, rng.choices("abcdefghij", k=rng.randint(0, 20))) for i in range(40)] + [(None, ["a", "x", "b"]), (99, None)]
    tag = {"a": "A", "b": "B", "c": "C"}
    got = m.open_between(spark.createDataFrame(docs, "doc_id long, toks array<string>"), spark.createDataFrame(list(tag.items()), "word string, tag string"), 3)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for i, t in docs[:-1]:
        for k, w in enumerate(t):
            left, right = [j for j in range(k) if t[j] in tag], [j for j in range(k + 1, len(t)) if t[j] in tag]
            if w not in tag and left and right and k - left[-1] <= 3 and right[0] - k <= 3:
                want.append((i, k, w, tag[t[left[-1]]], tag[t[right[0]]]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 20


def test_texts_of_models_are_made_once_for_their_profiles(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("'a' AS run", "split(lower(text), ' ') AS toks").where("text rlike '^[a-z ]+$'")
    got = generative.profiles(texts)
    assert not [f for f in got.inputFiles() if "documents" in f] and got.columns == ["run", "h1", "h2", "h3", "exponent", "ttr", "words"]


def test_draws_meet_words_in_packed_shards(spark):
    rng = np.random.default_rng(7)
    share = nulls.SHARE
    taken = [(0, k, 1) for k in range(0, 5000, 3)] + [(1, 0, 7), (1, 10, 990), (1, share - 5, 10), (1, 2 * share, 3 * share)]
    a, b, c = (rng.integers(0, n, 6000) for n in (5000, 6 * share, 1200))
    c[:20] = share + rng.integers(-8, 8, 20)
    draws = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist())), "a long, b long, c long").repartition(3)
    got = nulls.drawn_hits(draws, {"a": 0, "b": 1, "c": 1}, spark.createDataFrame(taken, "space int, start long, c long"))
    hit = lambda at, space: sum(any(s == space and x <= v < x + n for s, x, n in taken[1667:]) if space else v % 3 == 0 for v in at.tolist())
    assert {r["kind"]: r["hits"] for r in got.collect()} == {"a": hit(a, 0), "b": hit(b, 1), "c": hit(c, 1)}
    # a draw that is moved is little more than a byte, as it was a row
    at = np.sort(rng.integers(0, share, share // 250))
    assert (nulls.unpacked(nulls.packed(at)) == at).all() and len(zlib.compress(nulls.packed(at))) < 2 * len(at)


def test_known_neighbours_are_counted_in_their_rows(spark):
    assert "w1" not in "".join(line for line in planned(spark, "cross_document_shuffle").splitlines() if "Join" in line or "Aggregate [" in line)
    rng = random.Random(3)
    rows = [rng.choices("abcdz", k=rng.choice([0, 0, 1, 2, 9])) for _ in range(40)]
    pairs = [("a", "b"), ("b", "b"), ("d", "a"), ("e", "q")]
    docs = spark.createDataFrame([(r,) for r in [*rows, None]], "toks array<string>")
    got = nulls.known_neighbours(docs, spark.createDataFrame(pairs, "w1 string, w2 string")).first()
    all_ = [p for r in rows for p in zip(r, r[1:])]
    assert tuple(got) == (len(all_), sum(p in pairs for p in all_))
    assert nulls.known_neighbours(docs, spark.createDataFrame([], "w1 string, w2 string")).first()["known"] == 0
