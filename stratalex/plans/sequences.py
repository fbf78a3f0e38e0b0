"""Queries of matrices, graphs, decoders, ciphers and generators."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as ft
from stratalex.operators import anneal, automata, decode, factors, graph, search, stats, syllables
from stratalex.plans.registry import query
from stratalex.plans.sqltext import CHARS, DICT, PAIRS, TOKENS
from stratalex.plans.statistics import char_transitions
from stratalex.session import Tables, materialize, ship_package
from stratalex.sources.tables import dictionary, reference_bigrams, reference_docs, token_docs

#: Bounds of the reference tables that every worker gets whole; larger ones are an error.
REFERENCE_TEXTS, DICTIONARY_WORDS = 200_000, 2_000_000
r6 = lambda c: F.round(c, 6)

_ROWS = f"""WITH {TOKENS}, {PAIRS}, top AS (SELECT tok FROM (SELECT tok, count(*) AS c FROM tokens GROUP BY 1) ORDER BY c DESC, tok LIMIT 100),
n AS (SELECT w1, w2, count(*) AS c FROM pairs WHERE w1 IN (SELECT tok FROM top) AND w2 IN (SELECT tok FROM top) GROUP BY 1, 2), p AS (SELECT w1, w2, c / sqrt(sum(c * c) OVER (PARTITION BY w1)) AS u FROM n),
cs AS (SELECT a.w1 AS a, b.w1 AS b, sum(a.u * b.u) AS cosine FROM p a JOIN p b ON a.w2 = b.w2 AND a.w1 < b.w1 GROUP BY 1, 2 HAVING sum(a.u * b.u) >= 0.7)"""


def cosine_rows(spark, sf):
    """Pairs of the hundred most frequent words whose transition rows have a cosine of 0.7 or more."""
    docs = token_docs(spark, sf)
    best = F.broadcast(stats.top(stats.word_counts(docs), 100).select("tok"))
    n = stats.word_pairs(docs).join(best.withColumnRenamed("tok", "w1"), "w1", "left_semi").join(best.withColumnRenamed("tok", "w2"), "w2", "left_semi")
    p = n.withColumn("u", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("w1"))))
    a, b = p.select("w2", F.col("w1").alias("a"), F.col("u").alias("ua")), p.select("w2", F.col("w1").alias("b"), F.col("u").alias("ub"))
    return a.join(b, "w2").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine")).where("cosine >= 0.7")


@query(_ROWS + " SELECT a, b, round(cosine, 6) AS cosine FROM cs")
def transition_cosine_pairs(spark, sf):
    return cosine_rows(spark, sf).withColumn("cosine", r6(F.col("cosine")))


@query(_ROWS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT a AS x, b AS y FROM cs UNION SELECT b, a FROM cs), r(x, y) AS (SELECT x, x FROM e UNION SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS tok, min(y) AS component FROM r GROUP BY 1""")
def similarity_components(spark, sf):
    """Components of the words that are alike, by the smallest word reachable."""
    pairs = cosine_rows(spark, sf)
    names = pairs.select(F.explode(F.array("a", "b")).alias("tok")).distinct().withColumn("id", F.row_number().over(Window.orderBy("tok")).cast("long"))
    e = pairs.join(names.select(F.col("tok").alias("a"), F.col("id").alias("i")), "a").join(names.select(F.col("tok").alias("b"), F.col("id").alias("j")), "b")
    parts = graph.connected_components(e.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return names.join(parts, F.col("id") == F.col("node")).select("tok", F.col("component")).join(names.select(F.col("tok").alias("low"), F.col("id").alias("component")), "component").select("tok", F.col("low").alias("component"))


_CT = "ct AS (SELECT lang, c1, c2, count(*) AS c, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang, c1) AS p FROM nexts WHERE c2 IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"""WITH {TOKENS}, {CHARS}, {_CT}, g AS (SELECT DISTINCT lang FROM ct), k AS (SELECT a.lang AS a, b.lang AS b, x.c1, x.c2 FROM g a JOIN g b ON a.lang < b.lang JOIN (SELECT DISTINCT lang, c1, c2 FROM ct) x ON x.lang = a.lang
UNION SELECT a.lang, b.lang, x.c1, x.c2 FROM g a JOIN g b ON a.lang < b.lang JOIN (SELECT DISTINCT lang, c1, c2 FROM ct) x ON x.lang = b.lang)
SELECT k.a, k.b, round(sum(pow(coalesce(p.p, 0) - coalesce(q.p, 0), 2)), 6) AS cost, count(*) AS cells FROM k LEFT JOIN ct p ON p.lang = k.a AND p.c1 = k.c1 AND p.c2 = k.c2 LEFT JOIN ct q ON q.lang = k.b AND q.c1 = k.c1 AND q.c2 = k.c2 GROUP BY 1, 2""")
def mapping_cost(spark, sf):
    """Squared difference of the transition tables of each two languages under a mapping of their signs (here each to itself).

    From the squares of each table and the products of cells that both have.
    """
    t = char_transitions(spark, sf)
    one = t.groupBy("lang").agg(F.sum(F.col("p") * F.col("p")).alias("s"), F.count(F.lit(1)).alias("n"))
    a, b = (t.select(F.col("lang").alias(x), "c1", "c2", F.col("p").alias(f"p{x}")) for x in "ab")
    both = a.join(b, ["c1", "c2"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("x"), F.count(F.lit(1)).alias("m"))
    x, y = (one.select(F.col("lang").alias(k), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = x.join(y, F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    return pairs.select("a", "b", r6(F.greatest(F.col("sa") + F.col("sb") - 2 * F.coalesce("x", F.lit(0.0)), F.lit(0.0))).alias("cost"), (F.col("na") + F.col("nb") - F.coalesce("m", F.lit(0))).alias("cells"))


@query(f"WITH {TOKENS}, {CHARS}, {_CT}, s AS (SELECT lang, c1, sum(c) AS n, -sum(p * log2(p)) AS h FROM ct GROUP BY 1, 2) SELECT lang, round(sum(n * h) / sum(n), 6) AS entropy_rate, count(*) AS states FROM s GROUP BY 1")
def markov_entropy_rate(spark, sf):
    s = char_transitions(spark, sf).groupBy("lang", "c1").agg(F.sum("c").alias("n"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return s.groupBy("lang").agg(r6(F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("entropy_rate"), F.count(F.lit(1)).alias("states"))


@query(f"""WITH {TOKENS}, t AS (SELECT DISTINCT tok FROM tokens), p AS (SELECT DISTINCT left(tok, k) AS pre, k FROM (SELECT tok, unnest(range(1, length(tok) + 1)) AS k FROM t))
SELECT k AS depth, count(*) AS states, count(*) FILTER (pre IN (SELECT tok FROM t)) AS accepting FROM p GROUP BY 1""")
def trie_states(spark, sf):
    """States of the prefix tree of a vocabulary: its distinct beginnings.

    In order, each word adds the beginnings that are longer than what it shares
    with the word before it. Words are put in order within their first three
    letters, so no word's beginnings are written out; the shorter ones are
    counted by themselves.
    """
    t = token_docs(spark, sf).select(F.explode("toks").alias("tok")).distinct().withColumn("n", F.length("tok"))
    before = F.lag("tok").over(Window.partitionBy(F.left("tok", F.lit(3))).orderBy("tok"))

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(os.path.commonprefix((x, y))) if x else 3 for x, y in zip(a, b)], dtype="int32")

    long = t.where("n > 3").withColumn("before", before).withColumn("low", F.greatest(shared("before", "tok"), F.lit(3)))
    long = long.where("n > low").select(F.explode(F.sequence(F.col("low") + 1, F.col("n"))).alias("depth"))
    short = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(3))), lambda k: F.left("tok", k))).alias("pre")).distinct()
    states = long.unionByName(short.select(F.length("pre").alias("depth"))).groupBy("depth").agg(F.count(F.lit(1)).alias("states"))
    ends = t.groupBy(F.col("n").alias("depth")).agg(F.count(F.lit(1)).alias("accepting"))
    return states.join(ends, "depth", "left").select(F.col("depth").cast("long").alias("depth"), "states", F.coalesce("accepting", F.lit(0)).alias("accepting"))


@query(f"""WITH {TOKENS}, {DICT}, {PAIRS}, x AS (SELECT tok AS cur, lag(tok) OVER w AS prev, lead(tok) OVER w AS nxt FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT prev, cur, nxt, count(*) AS n FROM x WHERE prev IS NOT NULL AND nxt IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT c.* FROM c LEFT JOIN bigram a ON a.w1 = prev AND a.w2 = cur LEFT JOIN bigram z ON z.w1 = cur AND z.w2 = nxt WHERE coalesce(a.p, 0) < 0.001 AND coalesce(z.p, 0) < 0.001),
f AS (SELECT DISTINCT prev, nxt FROM k), m AS (SELECT f.prev, f.nxt, a.w2 AS word, a.p * z.p AS s, row_number() OVER (PARTITION BY f.prev, f.nxt ORDER BY a.p * z.p DESC, a.w2) AS q FROM f JOIN bigram a ON a.w1 = f.prev JOIN bigram z ON z.w1 = a.w2 AND z.w2 = f.nxt)
SELECT k.prev, k.cur, k.nxt, k.n, m.word, round(m.s, 6) AS score FROM k JOIN m ON m.prev = k.prev AND m.nxt = k.nxt AND m.q = 1 AND m.s > 0.05""")
def viterbi_smoothing(spark, sf):
    """Words that neither neighbour expects give way to the one both expect most; distinct contexts are scored once."""
    t = F.col("toks")
    at = F.when(F.size(t) > 2, F.sequence(F.lit(1), F.size(t) - 2)).otherwise(F.array().cast("array<int>"))
    tri = token_docs(spark, sf).select(F.explode(F.transform(at, lambda i: F.struct(F.get(t, i - 1).alias("prev"), F.get(t, i).alias("cur"), F.get(t, i + 1).alias("nxt")))).alias("x"))
    c = tri.groupBy("x.prev", "x.cur", "x.nxt").agg(F.count(F.lit(1)).alias("n"))
    p = reference_bigrams(spark, sf).select("w1", "w2", "p")
    k = c.join(p.select(F.col("w1").alias("prev"), F.col("w2").alias("cur"), F.col("p").alias("pa")), ["prev", "cur"], "left").join(p.select(F.col("w1").alias("cur"), F.col("w2").alias("nxt"), F.col("p").alias("pz")), ["cur", "nxt"], "left")
    low = lambda x: F.coalesce(x, F.lit(0.0)) < 0.001
    k = k.where(low("pa") & low("pz")).select("prev", "cur", "nxt", "n")
    via = p.select(F.col("w1").alias("prev"), F.col("w2").alias("word"), F.col("p").alias("pa")).join(p.select(F.col("w1").alias("word"), F.col("w2").alias("nxt"), F.col("p").alias("pz")), "word")
    via = via.withColumn("s", F.col("pa") * F.col("pz")).where("s > 0.05")
    w = Window.partitionBy("prev", "nxt").orderBy(F.desc("s"), "word")
    best = via.withColumn("q", F.row_number().over(w)).where("q = 1").select("prev", "nxt", "word", "s")
    return k.join(best, ["prev", "nxt"]).select("prev", "cur", "nxt", "n", "word", r6(F.col("s")).alias("score"))


_ABC, _KEY = "abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm"


@query(f"WITH {TOKENS} SELECT doc_id, md5(translate(array_to_string(toks, ' '), '{_ABC}', '{_KEY}')) AS cipher_md5 FROM d")
def substitution_cipher(spark, sf):
    return token_docs(spark, sf).select("doc_id", F.md5(F.translate(F.array_join("toks", " "), _ABC, _KEY)).alias("cipher_md5"))


@query(f"WITH {TOKENS}, c AS (SELECT doc_id, unnest(string_split(array_to_string(toks, ''), '')) AS ch, unnest(range(length(array_to_string(toks, '')))) AS i FROM d WHERE len(toks) > 0) "
       "SELECT doc_id, md5(string_agg(chr(CAST(97 + (ascii(ch) - 97 + [10, 4, 24][(i % 3) + 1]) % 26 AS INT)), '' ORDER BY i)) AS cipher_md5 FROM c GROUP BY 1")  # fmt: skip
def vigenere_cipher(spark, sf):
    """Letters moved by the letters of a key in turn."""
    shift = F.array(F.lit(10), F.lit(4), F.lit(24))
    chars = token_docs(spark, sf).where(F.size("toks") > 0).select("doc_id", stats.chars_of(F.col("toks")).alias("c"))
    moved = F.transform("c", lambda x, i: F.char(F.lit(97) + (F.ascii(x) - 97 + F.get(shift, i % 3)) % 26))
    return chars.select("doc_id", F.md5(F.array_join(moved, "")).alias("cipher_md5"))


def _letter_tables(spark, sf):
    """(lang, cells): the 26 x 26 transition table of each language, row by row."""
    t = char_transitions(spark, sf).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("c1", "c2"), "p"))).alias("p"))  # 676 cells at most
    pairs = F.array(*(F.lit(x + y) for x in _ABC for y in _ABC))
    return t.select("lang", F.transform(pairs, lambda k: F.coalesce(F.element_at("p", k), F.lit(0.0))).alias("cells"))


def _square(cells):
    return np.array(cells, float).reshape(26, 26)


@query()
def assignment_letters(spark, sf):
    """Letters of each language for those of each other one, by least distance of their sorted transition rows; a task takes pairs of languages."""
    ship_package(spark)
    t = _letter_tables(spark, sf)
    pairs = t.select(F.col("lang").alias("a"), F.col("cells").alias("p")).join(t.select(F.col("lang").alias("b"), F.col("cells").alias("q")), F.col("a") < F.col("b"))

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                a, b = np.sort(_square(r.p), axis=1), np.sort(_square(r.q), axis=1)
                cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
                col = search.assign(cost)
                yield pd.DataFrame({"a": r.a, "b": r.b, "letter": list(_ABC), "image": [_ABC[j] for j in col], "distance": np.round(cost[np.arange(26), col], 6)})

    return pairs.mapInPandas(run, "a string, b string, letter string, image string, distance double")


def _adjacent(docs, n):
    """The ``n`` most frequent words of ``docs``, in order, and how often each stands before each: n x n cells at most."""
    words = [r["tok"] for r in stats.top(stats.word_counts(docs), n).collect()]
    names = docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words)], "tok string, i int")
    pairs = stats.word_pairs(docs).join(F.broadcast(names.toDF("w1", "i")), "w1").join(F.broadcast(names.toDF("w2", "j")), "w2")
    m = np.zeros((len(words), len(words)))
    for r in pairs.select("i", "j", "n").collect():
        m[r["i"], r["j"]] = r["n"]
    return words, m


def _often(m):
    """Pairs that stand together more often than their numbers make likely."""
    both, one = m + m.T, (m + m.T).sum(axis=1)
    return both * max(one.sum(), 1) > np.outer(one, one)


#: Words of a document and of the reference that are mapped, and ranks in which a crib looks for a word of the same first letter.
MAPPED, IMAGES, CRIB_RANKS = 100, 120, 30


@query()
def annealed_mapping(spark, sf):
    """Frequent words of the documents mapped to those of the reference: replica exchange over transitions, cribs, ranks and topics."""
    ship_package(spark)
    words, m = _adjacent(token_docs(spark, sf), MAPPED)
    images, k = _adjacent(reference_docs(spark, sf), IMAGES)
    cribs = np.array([[w[0] == x[0] and abs(i - j) <= CRIB_RANKS for j, x in enumerate(images)] for i, w in enumerate(words)]).reshape(len(words), len(images))
    rows = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    problem = anneal.Problem(rows(m), rows(k), cribs, _often(m), _often(k))
    best = anneal.exchange(spark, problem, chains=2, swaps=len(images) >= len(words))
    names = F.array(*map(F.lit, words)), F.array(*map(F.lit, images))
    each = best.select("chain", r6(F.col("cost")).alias("cost"), F.posexplode("image").alias("i", "j"))
    return each.select("chain", "cost", F.get(names[0], F.col("i")).alias("word"), F.get(names[1], F.col("j")).alias("image"))


@query()
def markov_structure(spark, sf):
    """Entropy rate, second eigenvalue, mixing time and irreversibility of each language's letters; a task takes languages."""
    ship_package(spark)

    def run(frames):
        for f in frames:
            rows = [(r.lang, *(round(v, 6) for v in search.markov(_square(r.cells) + 1e-12).values())) for r in f.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["lang", "entropy_rate", "second", "mixing", "irreversible"])

    return _letter_tables(spark, sf).mapInPandas(run, "lang string, entropy_rate double, second double, mixing double, irreversible double")


#: Words that have topics and clusters, how far apart they stand together, topics, and steps of the factors.
VOCABULARY, NEAR, TOPICS, TOPIC_STEPS = 2000, 5, 5, 15
#: Spectral directions, their steps, and the numbers of clusters that are tried.
DIRECTIONS, SPECTRAL_STEPS, CLUSTERS = 8, 15, range(3, 9)


def _together(spark, sf, words, tables):
    """(names, cells): the frequent words by number, and how often they stand near each other."""
    docs = token_docs(spark, sf)
    ranked = stats.top(stats.word_counts(docs), words)
    names = tables.put(ranked.select("tok", (F.row_number().over(Window.orderBy(F.desc("c"), "tok")) - 1).alias("i")), "names")
    return names, tables.put(factors.cooccurrence(docs, names, NEAR), "cells")


@query()
def topic_factors(spark, sf):
    """Topics of two thousand words by non-negative factors of how often they stand near each other."""
    tables = Tables(spark)
    names, cells = _together(spark, sf, VOCABULARY, tables)
    w, _, losses = factors.nmf(cells, TOPICS, TOPIC_STEPS)
    most = F.array_max("v")
    found = names.join(w, "i").select("tok", (F.array_position("v", most) - 1).cast("int").alias("topic"), r6(most / F.greatest(F.aggregate("v", F.lit(0.0), lambda s, a: s + a), F.lit(1e-12))).alias("weight"))
    return found.withColumn("loss", F.lit(losses[-1]))


@query()
def word_clusters(spark, sf):
    """Clusters of two thousand words by spectral coordinates; the number of clusters whose silhouette is best."""
    tables = Tables(spark)
    names, cells = _together(spark, sf, VOCABULARY, tables)
    q, _ = factors.spectral(cells, DIRECTIONS, SPECTRAL_STEPS)
    best = None
    for k in CLUSTERS:
        labels, centres = factors.kmeans(q, k, DIRECTIONS)
        score = factors.simplified_silhouette(labels, centres)
        if best is None or score > best[0]:
            best = (score, len(centres), labels)
    return names.join(best[2], "i").select("tok", F.col("label").alias("cluster"), F.lit(best[1]).alias("clusters"), F.lit(round(best[0], 6)).alias("silhouette"))


def _vocabulary(spark, sf):
    return token_docs(spark, sf).select(F.coalesce("lang", F.lit("")).alias("g"), F.explode("toks").alias("tok")).distinct()


_ENDINGS = f"""WITH {TOKENS}, t AS (SELECT DISTINCT coalesce(lang, '') AS g, tok FROM tokens), p AS (SELECT g, k, left(tok, k) AS s, substr(tok, k + 1) AS rest FROM (SELECT g, tok, unnest(range(length(tok) + 1)) AS k FROM t)),
st AS (SELECT g, s, k, max(rest = '') AS acc, string_agg(DISTINCT left(rest, 1), '' ORDER BY left(rest, 1)) AS letters, md5(string_agg(rest, ',' ORDER BY rest)) AS tail FROM p GROUP BY 1, 2, 3)"""


@query(_ENDINGS + " SELECT g AS lang, count(*) FILTER (acc) AS words, count(*) AS trie, count(DISTINCT (k, acc, letters)) AS merged, count(DISTINCT tail) AS minimal FROM st GROUP BY 1")
def automaton_states(spark, sf):
    """Prefix tree of each language's whole vocabulary; states merged by depth and letters, and the minimal automaton."""
    states = automata.prefix_tree(_vocabulary(spark, sf))
    return states.groupBy(F.col("g").alias("lang")).agg(
        F.count(F.when(F.col("accepting"), 1)).alias("words"), F.count(F.lit(1)).alias("trie"), F.count_distinct("depth", "accepting", "letters").alias("merged"), F.count_distinct("tail").alias("minimal"))


#: Letters that a state of the context automaton remembers.
ORDER = 2


def _contexts(spark, sf, tables):
    """(edges, accepting) of the context automata, written once: at most 27^2 states of 26 letters a language."""
    words = tables.put(_vocabulary(spark, sf), "words")
    return [tables.put(t, "contexts") for t in automata.contexts(words, ORDER)]


def _context_topology(edges, accepting):
    return automata.topology(edges, accepting, edges.select("g").distinct().withColumn("s", F.lit("^" * ORDER)))


@query()
def context_automaton(spark, sf):
    """The automaton of two remembered letters of each language, with its cycles: size, depth, branching, and its minimal states by partition refinement."""
    tables = Tables(spark)
    edges, accepting = _contexts(spark, sf, tables)
    minimal = automata.minimise(edges, accepting).groupBy("g").agg(F.count_distinct("class").alias("minimal"))
    t, _ = materialize(_context_topology(edges, accepting).join(minimal, "g"), "topology")
    tables.drop()
    return t.select(F.col("g").alias("lang"), "states", "transitions", "accepting", "letters", r6(F.col("branching")).alias("branching"), "widest", "depth", "cycles", r6(F.col("density")).alias("density"), "minimal")


@query()
def automaton_likeness(spark, sf):
    """How alike the context automata of each two languages are."""
    tables = Tables(spark)
    t, _ = materialize(_context_topology(*_contexts(spark, sf, tables)), "topology")
    tables.drop()
    return automata.likeness(t).select("a", "b", r6(F.col("likeness")).alias("likeness"))


@query()
def budgeted_decode(spark, sf):
    """Documents under a budget: short words stand for themselves, affixes are stripped, words of the document's field are boosted."""
    from stratalex.plans.analyses import lexicon

    ship_package(spark)
    d = dictionary(spark, sf)
    total = d.agg(F.sum("freq")).first()[0] or 1
    words = [(r["skel"], r["word"], r["freq"] / total) for r in decode.bounded(d.withColumn("skel", ft.skeleton(F.col("word"))).where("skel <> ''").orderBy("word"), DICTIONARY_WORDS, "the dictionary")]
    known = {w for _, w, _ in words}
    same = lambda affixes: {x: [x] for x in affixes}
    decoder = decode.BudgetedDecoder(words, {w: w for w in known if len(w) == 1}, (same(ft.PARSE_PREFIXES), same(ft.PARSE_SUFFIXES)))
    topics = [set() for _ in range(12)]
    for r in decode.bounded(lexicon(spark, sf), DICTIONARY_WORDS, "the lexicon"):
        topics[r["field"]].add(r["word"])
    rows = decode.decode_documents(token_docs(spark, sf), decoder, [frozenset(t) for t in topics])
    return rows.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("words"))


@query()
def beam_decode(spark, sf):
    ship_package(spark)
    sentences = [r["toks"] for r in decode.bounded(reference_docs(spark, sf).orderBy("item_id"), REFERENCE_TEXTS, "the reference corpus")]
    index: dict[str, list[str]] = {}
    for r in decode.bounded(dictionary(spark, sf).orderBy(F.desc("freq"), "word"), DICTIONARY_WORDS, "the dictionary"):
        index.setdefault(r["word"][:2], []).append(r["word"])
    docs = token_docs(spark, sf).select("doc_id", "toks")
    return decode.beam_documents(docs, sentences, index).select("doc_id", "n", r6(F.col("score")).alias("score"), F.md5("decoded").alias("decoded_md5"))


#: Beginnings and endings of two letters that are read, by frequency.
AFFIXES = 30


@query()
def syllable_beam(spark, sf):
    """Documents read as a stream of the reference's syllables: affixes by rank, transitions of syllables, a beam of fifteen."""
    ship_package(spark)
    d = dictionary(spark, sf).select("word", "freq", ft.syllables(F.col("word")).alias("syls"))
    after: dict[str, dict[str, float]] = {}
    for r in decode.bounded(syllables.transitions(d), DICTIONARY_WORDS, "the table of syllables"):
        after.setdefault(r["s1"], {})[r["s2"]] = r["p"]
    counts = stats.word_counts(token_docs(spark, sf))

    def often(table, part, n):
        return [r[0] for r in table.groupBy(part).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), part).limit(n).collect()]

    reference = d.select(F.col("word").alias("tok"), F.col("freq").alias("c"), "syls")
    affixes: dict[str, list[str]] = {}
    for own, other in ((F.left("tok", F.lit(2)), F.get("syls", F.lit(0))), (F.right("tok", F.lit(2)), F.element_at("syls", -1))):
        mine, theirs = often(counts.where(F.length("tok") > 3).select("c", own.alias("k")), F.col("k"), AFFIXES), often(reference.where(F.size("syls") > 0).select("c", other.alias("k")), F.col("k"), AFFIXES + 1)
        for i, affix in enumerate(mine):
            affixes[affix] = sorted({*affixes.get(affix, ()), *theirs[i : i + 2]})
    found = syllables.decode_documents(token_docs(spark, sf), after, affixes)
    return found.select("doc_id", "n", r6(F.col("score")).alias("score"), F.md5("decoded").alias("decoded_md5"))
