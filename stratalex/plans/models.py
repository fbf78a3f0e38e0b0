"""Queries of ciphers, generators, null models, adversarial checks and further composed analyses."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as ft
from stratalex.operators import generative, grammar, nulls, search, stats
from stratalex.plans.registry import query
from stratalex.plans.sequences import _ABC, _KEY
from stratalex.plans.sqltext import CHARS, DICT, TOKENS, skeleton
from stratalex.plans.statistics import profile
from stratalex.session import drop_path, materialize, ship_package
from stratalex.sources.tables import dictionary, fixed, reference_bigrams, table, token_docs

r6 = lambda c: F.round(c, 6)
#: Places are dealt in buckets of about so many when words change places over all documents; each is sorted by itself.
BUCKET_ROWS = 65536
_TYPES = "types AS (SELECT tok, count(*) AS c FROM tokens GROUP BY 1)"


def draw(n, *parts):
    """A number from 0 below ``n`` by the md5 of ``parts``, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long") % n


def draw_sql(n, *parts):
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT) % ({n}))"


def _chars(spark, sf):
    return token_docs(spark, sf).where(F.size("toks") > 0).select("doc_id", stats.chars_of(F.col("toks")).alias("c"))


def _digest(docs, f):
    return docs.select("doc_id", F.md5(F.array_join(F.transform("c", f), "")).alias("cipher_md5"))


def _cipher_sql(sign):
    return f"WITH {TOKENS}, {CHARS} SELECT doc_id, md5(string_agg({sign}, '' ORDER BY i)) AS cipher_md5 FROM chars GROUP BY 1"


@query(_cipher_sql("ch || CAST((i * i + 7 * doc_id + ascii(ch)) % 3 AS VARCHAR)"))
def homophonic_cipher(spark, sf):
    """Each letter has three signs, chosen by its place."""
    sign = lambda x, i: F.concat(x, ((i.cast("long") * i + 7 * F.col("doc_id") + F.ascii(x)) % 3).cast("string"))
    return _digest(_chars(spark, sf), sign)


@query(_cipher_sql("chr(CAST(97 + ((ascii(ch) - 97) * 3 + 1) % 26 AS INT)) || chr(CAST(97 + ((ascii(ch) - 97) * 7 + 2) % 26 AS INT))"))
def verbose_cipher(spark, sf):
    """Each letter becomes a word of two."""
    k = lambda x: F.ascii(x) - 97
    return _digest(_chars(spark, sf), lambda x, i: F.concat(F.char(97 + (k(x) * 3 + 1) % 26), F.char(97 + (k(x) * 7 + 2) % 26)))


@query(_cipher_sql("chr(CAST(97 + (ascii(ch) - 97 + [3, 11, 19][(i // 2 + doc_id) % 3 + 1]) % 26 AS INT)) || CASE WHEN (i + doc_id) % 3 = 0 THEN '' ELSE ' ' END"))
def multi_table_cipher(spark, sf):
    """Tables of signs in turn, two letters each, with new word breaks: one or two letters make a word."""
    shifts = F.array(F.lit(3), F.lit(11), F.lit(19))

    def sign(x, i):
        at = ((F.floor(i / 2) + F.col("doc_id")) % 3).cast("int")
        return F.concat(F.char(97 + (F.ascii(x) - 97 + F.get(shifts, at)) % 26), F.when((i + F.col("doc_id")) % 3 == 0, "").otherwise(" "))

    return _digest(_chars(spark, sf), sign)


@query(f"""WITH {TOKENS}, {_TYPES}, code AS (SELECT tok, row_number() OVER (ORDER BY c DESC, tok) AS code FROM types QUALIFY code <= 50)
SELECT doc_id, md5(string_agg(coalesce(CAST(code AS VARCHAR), translate(t.tok, '{_ABC}', '{_KEY}')), ' ' ORDER BY pos)) AS cipher_md5 FROM tokens t LEFT JOIN code USING (tok) GROUP BY 1""")
def nomenclator_cipher(spark, sf):
    """The fifty most frequent words are code numbers; letters of all others are exchanged."""
    docs = token_docs(spark, sf).where(F.size("toks") > 0)
    best = stats.top(stats.word_counts(docs), 50).withColumn("code", F.row_number().over(Window.orderBy(F.desc("c"), "tok")).cast("string"))
    codes = best.agg(F.map_from_entries(F.collect_list(F.struct("tok", "code"))).alias("m"))
    sign = lambda t: F.coalesce(F.try_element_at(F.col("m"), t), F.translate(t, _ABC, _KEY))
    return docs.join(F.broadcast(codes)).select("doc_id", F.md5(F.array_join(F.transform("toks", sign), " ")).alias("cipher_md5"))  # one row of 50


@query(f"WITH {TOKENS} SELECT doc_id, md5(string_agg(left(tok, 1), '' ORDER BY pos) FILTER (pos % 5 = 0)) AS hidden_md5 FROM tokens GROUP BY 1")
def hidden_letters(spark, sf):
    """What a carrier text would hide in the first letter of every fifth word."""
    docs = token_docs(spark, sf).where(F.size("toks") > 0)
    return docs.select("doc_id", F.md5(F.array_join(F.transform(F.filter("toks", lambda t, i: i % 5 == 0), lambda t: F.left(t, F.lit(1))), "")).alias("hidden_md5"))


_SLOT = "(SELECT list(p ORDER BY n DESC, p)[1:10] FROM (SELECT {0} AS p, sum(c) AS n FROM types WHERE length(tok) >= 6 GROUP BY 1))"
_CUTS = {"a": ("left(tok, 2)", "left(tok, 2)"), "b": ("substr(tok, 3, 2)", "substr(tok, 3, 2)"), "z": ("right(tok, 2)", "right(tok, 2)")}


@query(f"""WITH {TOKENS}, {_TYPES}, s AS (SELECT {', '.join(f"{_SLOT.format(sql)} AS {k}" for k, (_, sql) in _CUTS.items())}), g AS (SELECT unnest(range(500)) AS id)
SELECT id, a[{draw_sql('len(a)', "'a'", 'id')} + 1] || b[{draw_sql('len(b)', "'b'", 'id')} + 1] || z[{draw_sql('len(z)', "'z'", 'id')} + 1] AS word FROM g, s""")
def slot_words(spark, sf):
    """Five hundred words from a table of frequent beginnings, middles and ends, read through a moving grille of seeded draws."""
    types = stats.word_counts(token_docs(spark, sf)).where("length(tok) >= 6")
    cells = None
    for k, (cut, _) in _CUTS.items():
        part = types.groupBy(F.expr(cut).alias("p")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "p").limit(10)
        part = part.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "p"))), lambda x: x["p"]).alias(k))
        cells = part if cells is None else cells.join(F.broadcast(part))
    rows = spark.range(500).join(F.broadcast(cells))  # three lists of ten
    pick = [F.get(k, draw(F.size(k), F.lit(k), F.col("id")).cast("int")) for k in _CUTS]
    return rows.select("id", F.concat(*pick).alias("word"))


@query()
def markov_text(spark, sf):
    """A text for each document, as long as it is, drawn by the transitions of the reference's words."""
    from stratalex.operators.decode import bounded
    from stratalex.plans.sequences import DICTIONARY_WORDS

    ship_package(spark)
    w = Window.partitionBy("w1").orderBy("w2")
    share = reference_bigrams(spark, sf).select("w1", "w2", F.sum("p").over(w).alias("upto"))
    after: dict[str, tuple[list[str], list[float]]] = {}
    for r in bounded(share.orderBy("w1", "w2"), 4 * DICTIONARY_WORDS, "the table of transitions"):
        nexts = after.setdefault(r["w1"], ([], []))
        nexts[0].append(r["w2"])
        nexts[1].append(r["upto"])
    docs = token_docs(spark, sf).select("doc_id", F.size("toks").alias("n"))
    return search.chained(docs, after).select("doc_id", F.size(F.filter(F.split("text", " "), lambda x: x != "")).alias("words"), F.md5("text").alias("text_md5"))


#: Sides of the grille's table, and where the holes of the grilles of one to four are, by cell.
SIDE = 12
HOLES = {n: [int(hashlib.md5(f"{n}|{h}".encode()).hexdigest()[:8], 16) % SIDE**2 for h in range(n)] for n in range(1, 5)}
#: Documents by number that are added up at a time.
GRILLE_DOCS = 4096
_HOLE = lambda h: f"tb[({h // SIDE} + moved // {SIDE}) % {SIDE} * {SIDE} + ({h % SIDE} + moved) % {SIDE} + 1]"
_THROUGH = "CASE " + " ".join(f"WHEN {cond} THEN {' || '.join(map(_HOLE, HOLES[n]))}" for n, cond in ((1, "len <= 3"), (2, "len <= 5"), (3, "len <= 7"))) + f" ELSE {' || '.join(map(_HOLE, HOLES[4]))} END"


@query(f"""WITH {TOKENS}, {_TYPES}, tb AS (SELECT list(p ORDER BY n DESC, p)[1:{SIDE**2}] AS t FROM (SELECT left(tok, 2) AS p, sum(c) AS n FROM types WHERE length(tok) >= 2 GROUP BY 1)),
tt AS (SELECT list_transform(range({SIDE**2}), lambda i: t[i % len(t) + 1]) AS tb FROM tb),
x AS (SELECT doc_id, pos, length(tok) AS len, row_number() OVER (ORDER BY doc_id, pos) - 1 AS moved FROM tokens), w AS (SELECT doc_id, pos, len, {_THROUGH} AS word FROM x, tt)
SELECT doc_id, count(*) AS words, md5(string_agg(CASE WHEN length(word) > len + 2 THEN left(word, len + 1) ELSE word END, ' ' ORDER BY pos)) AS text_md5 FROM w GROUP BY 1""")
def moving_grille(spark, sf):
    """Each document's words written through a grille that moves over a table of syllables, one step a word, from document to document.

    How far the grille has moved is a sum of the documents before: by ranges of
    their numbers, then within a range. The rest is within the row.
    """
    docs = token_docs(spark, sf).where("size(toks) > 0 and doc_id is not null").select("doc_id", "toks")
    size = docs.select("doc_id", F.floor(F.col("doc_id") / GRILLE_DOCS).alias("part"), F.size("toks").cast("long").alias("n"))
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = size.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(to_here(Window.orderBy("part"))), F.lit(0)).alias("base"))
    before = size.join(parts, "part").select("doc_id", (F.col("base") + F.coalesce(F.sum("n").over(to_here(Window.partitionBy("part").orderBy("doc_id"))), F.lit(0))).alias("before"))
    syllables = stats.word_counts(docs).where("length(tok) >= 2").groupBy(F.left("tok", F.lit(2)).alias("p")).agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "p").limit(SIDE**2)
    ranked = syllables.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "p"))), lambda x: x["p"]).alias("t"))
    table_ = ranked.select(F.transform(F.sequence(F.lit(0), F.lit(SIDE**2 - 1)), lambda i: F.get("t", i % F.size("t"))).alias("tb"))
    rows = docs.join(before, "doc_id").join(F.broadcast(table_))  # one row of 144 syllables

    def seen(at, n):
        holes = [F.get("tb", ((F.lit(h // SIDE) + F.floor(at / SIDE)) % SIDE * SIDE + (F.lit(h % SIDE) + at) % SIDE).cast("int")) for h in HOLES[n]]
        return F.concat(*holes)

    def word(tok, i):
        at, length = F.col("before") + i, F.length(tok)
        whole = F.when(length <= 3, seen(at, 1)).when(length <= 5, seen(at, 2)).when(length <= 7, seen(at, 3)).otherwise(seen(at, 4))
        return F.when(F.length(whole) > length + 2, F.left(whole, length + 1)).otherwise(whole)

    return rows.select("doc_id", F.size("toks").cast("long").alias("words"), F.md5(F.array_join(F.transform("toks", word), " ")).alias("text_md5"))


def _best_grammar(spark, sf):
    counts, path = materialize(stats.word_counts(token_docs(spark, sf)), "words")
    best, _ = grammar.evolve(counts)
    drop_path(spark, path)
    return best


@query()
def grammar_search(spark, sf):
    """Grammars of words bred on islands: rules and letters of the best of each, and the bits a letter that all words of the corpus take by it."""
    ship_package(spark)
    rows = []
    for island, (g, bits) in enumerate(_best_grammar(spark, sf)):
        total = {left: sum(w for a, _, w in g.rules if a == left) for left, _, _ in g.rules}
        rows += [(island, round(bits, 6), left, " ".join(right), round(w / total[left], 6)) for left, right, w in g.rules]
        rows += [(island, round(bits, 6), s, c, round(float(p), 6)) for s, w in g.spend.items() for c, p in zip(grammar.LETTERS, w / w.sum())]
    return spark.createDataFrame(rows, "island int, bits double, symbol string, becomes string, share double")


@query()
def grammar_text(spark, sf):
    """A text of the best grammar for each document, with as many words as the document has."""
    ship_package(spark)
    best = min(_best_grammar(spark, sf), key=lambda x: x[1])[0]
    docs = token_docs(spark, sf).select("doc_id", F.size("toks").alias("n"))
    return grammar.spelled(docs, best, "n").select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("words"), F.md5("text").alias("text_md5"))


# null models: the share of words whose skeleton the dictionary has

_KNOWN = f"known AS (SELECT DISTINCT {skeleton('word')} AS skel FROM dict WHERE {skeleton('word')} <> '')"
_NULLS = f"""sizes AS (SELECT count(*) AS nv, CAST(sum(c) AS BIGINT) AS nt FROM types),
laid AS (SELECT tok, c, row_number() OVER (ORDER BY md5(tok), tok) - 1 AS k, CAST(sum(c) OVER (ORDER BY md5(tok), tok) AS BIGINT) - c AS start FROM types),
lc AS (SELECT ch, sum(c) AS n FROM (SELECT unnest(string_split(tok, '')) AS ch, c FROM types) GROUP BY 1), ln AS (SELECT ch, sum(n) OVER (ORDER BY ch) AS upto, sum(n) OVER () AS total FROM lc),
slots AS (SELECT list(ch ORDER BY s) AS v FROM (SELECT s, min(ch) AS ch FROM ln, (SELECT unnest(range(256)) AS s) WHERE upto * 256 > s * total GROUP BY 1)),
pl AS (SELECT doc_id, pos, tok, {draw_sql('nv', "'u'", 'doc_id', 'pos')} AS u, {draw_sql('nt', "'q'", 'doc_id', 'pos')} AS q, {draw_sql('nt', "'g'", 'doc_id', 'pos')} AS g FROM tokens, sizes),
noise AS (SELECT array_to_string(list_transform(range(length(tok)), lambda i: v[CAST('0x' || substr(md5(concat_ws('|', 'c', doc_id, pos, i // 16)), CAST(i % 16 * 2 + 1 AS BIGINT), 2) AS BIGINT) + 1]), '') AS tok FROM tokens, slots)"""


@query(f"""WITH {TOKENS}, {DICT}, {_TYPES}, {_KNOWN}, {_NULLS}, w AS (SELECT 'corpus' AS kind, tok, c FROM types UNION ALL
SELECT 'uniform', l.tok, count(*) FROM pl JOIN laid l ON l.k = pl.u GROUP BY 2 UNION ALL
SELECT 'frequency', l.tok, count(*) FROM pl ASOF JOIN laid l ON pl.q >= l.start GROUP BY 2 UNION ALL SELECT 'pool', l.tok, count(*) FROM pl ASOF JOIN laid l ON pl.g >= l.start GROUP BY 2 UNION ALL
SELECT 'letters', tok, count(*) FROM noise GROUP BY 2)
SELECT kind, CAST(sum(c) AS BIGINT) AS words, round(sum(CASE WHEN {skeleton('tok')} IN (SELECT skel FROM known) THEN c ELSE 0 END) * 1.0 / sum(c), 6) AS rate FROM w GROUP BY 1""")
def null_model_rates(spark, sf):
    """The corpus against four null texts of its size: words of the whole vocabulary at even odds, by frequency, of the pool of all words, and random letters by their frequency.

    The vocabulary is laid out in buckets by hash, each ordered by itself; a draw
    is a place in it, where words take one place or as many as they are frequent: places go to
    shards, packed, and meet the words there. (Orders of the
    words within documents and over all documents are ``shuffle_null_pvalue``
    and ``cross_document_shuffle``.)
    """
    ship_package(spark)
    docs = token_docs(spark, sf).where(F.size("toks") > 0).select("doc_id", "toks")
    known, known_path = materialize(dictionary(spark, sf).select(ft.skeleton(F.col("word")).alias("skel")).where("skel <> ''").distinct().withColumn("hit", F.lit(True)), "known")
    # whether the dictionary has a word's skeleton is found once a type; draws only count what they meet
    types, path = materialize(stats.word_counts(docs).withColumn("skel", ft.skeleton(F.col("tok"))).join(known, "skel", "left").select("tok", "c", F.coalesce("hit", F.lit(False)).alias("hit")), "types")
    types = types.withColumn("h", F.md5("tok")).withColumn("b", F.left("h", F.lit(3)))
    # 4096 buckets by hash, in the order of the hash; what is ordered as a whole is one row a bucket
    sums = types.groupBy("b").agg(F.count(F.lit(1)).alias("nb"), F.sum("c").alias("cb"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("b", F.coalesce(F.sum("nb").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("cb").over(before), F.lit(0)).alias("c0"))
    own = Window.partitionBy("b").orderBy("h", "tok")
    upto = F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, 0))
    laid = types.withColumn("k", F.row_number().over(own) - 1).withColumn("start", upto - F.col("c")).join(F.broadcast(sums), "b")
    # a draw meets one word always, so only words with a hit are looked for
    laid = laid.where("hit").select("c", (F.col("k") + F.col("n0")).alias("k"), (F.col("start") + F.col("c0")).alias("start"))
    sizes = types.agg(F.count(F.lit(1)).alias("nv"), F.sum("c").alias("nt"))
    at = docs.join(F.broadcast(sizes)).select("doc_id", "nv", "nt", F.posexplode("toks").alias("pos", "tok"))
    places = at.select(*(draw(F.col(n), F.lit(x), F.col("doc_id"), F.col("pos")).alias(kind) for kind, n, x in (("uniform", "nv", "u"), ("frequency", "nt", "q"), ("pool", "nt", "g"))))
    taken = laid.select(F.inline(F.array(F.struct(F.lit(0).alias("space"), F.col("k").alias("start"), F.lit(1).cast("long").alias("c")), F.struct(F.lit(1).alias("space"), "start", "c"))))
    found = [nulls.drawn_hits(places, {"uniform": 0, "frequency": 1, "pool": 1}, taken)]

    # 26 letters at most
    letters = types.select("c", F.explode(F.split("tok", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.sum("c").alias("n"))
    ranked = letters.agg(F.sort_array(F.collect_list(F.struct("ch", "n"))).alias("l"))
    ends = F.transform("l", lambda x, i: F.aggregate(F.slice("l", F.lit(1), i + 1), F.lit(0).cast("long"), lambda t, y: t + y["n"]))
    slot = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda s: F.get("l", F.size(F.filter("ends", lambda u: u * 256 <= s * F.element_at("ends", -1))))["ch"])
    slots = ranked.withColumn("ends", ends).select(slot.alias("v"))
    # a sign is a byte of a hash of sixteen: all bytes of a word are turned into letters at once
    part = lambda i: F.md5(F.concat_ws("|", F.lit("c"), F.col("doc_id").cast("string"), F.col("pos").cast("string"), i.cast("string")))
    size = F.length("tok")
    bytes_ = F.when(size <= 16, part(F.lit(0))).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 16)), part), ""))
    signs = F.call_function("translate", F.decode(F.unhex(bytes_), "ISO-8859-1"), F.lit("".join(map(chr, range(256)))), F.col("v"))
    noise = at.join(F.broadcast(fixed(slots.select(F.array_join("v", "").alias("v")), "v"))).select(F.left(signs, size).alias("tok"))
    # words of random letters have about as many skeletons as there are words: they meet the dictionary's before anything is counted
    noise = noise.select(ft.skeleton(F.col("tok")).alias("skel")).join(known, "skel")
    found.append(noise.groupBy(F.lit("letters").alias("kind")).agg(F.count(F.lit(1)).alias("hits")))

    found.append(types.where("hit").groupBy(F.lit("corpus").alias("kind")).agg(F.sum("c").alias("hits")))
    hits = reduce(lambda a, b: a.unionByName(b), found).groupBy("kind").agg(F.sum("hits").alias("hits"))
    kinds = sizes.where("nt > 0").select(F.col("nt").alias("words"), F.explode(F.array(*map(F.lit, ("corpus", "uniform", "frequency", "pool", "letters")))).alias("kind"))
    done, _ = materialize(kinds.join(hits, "kind", "left").select("kind", "words", r6(F.coalesce("hits", F.lit(0)) / F.col("words")).alias("rate")), "rates")
    drop_path(spark, path)
    drop_path(spark, known_path)
    return done


_BUCKET = f"bk AS (SELECT greatest(1, count(*) // {BUCKET_ROWS}) AS nb FROM tokens), a AS (SELECT doc_id, pos, tok, {draw_sql('nb', chr(39) + 'b' + chr(39), 'doc_id', 'pos')} AS b FROM tokens, bk)"


@query(f"""WITH {TOKENS}, {DICT}, {_BUCKET}, fr AS (SELECT tok, b, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', 'f', doc_id, pos)), doc_id, pos) AS k FROM a),
tt AS (SELECT doc_id, pos, b, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', 't', doc_id, pos)), doc_id, pos) AS k FROM a),
m AS (SELECT tt.doc_id, tt.pos, fr.tok FROM tt JOIN fr ON fr.b = tt.b AND fr.k = tt.k), p AS (SELECT tok AS w1, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM m),
q AS (SELECT tok AS w1, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tokens), u AS (SELECT 'corpus' AS kind, * FROM q WHERE w2 IS NOT NULL UNION ALL SELECT 'shuffled', * FROM p WHERE w2 IS NOT NULL)
SELECT kind, count(*) AS pairs, count(g.w1) AS known FROM u LEFT JOIN bigram g ON g.w1 = u.w1 AND g.w2 = u.w2 GROUP BY 1""")
def cross_document_shuffle(spark, sf):
    """Known word pairs of the corpus and of its words dealt anew over all documents.

    An exact permutation without a global sort: places are dealt in buckets of
    about ``BUCKET_ROWS``, so their number follows the corpus, and the words of
    each bucket take its places in another seeded order.
    """
    from stratalex.sources.tables import explode_tokens

    ship_package(spark)
    docs = token_docs(spark, sf)
    t = explode_tokens(docs).select("doc_id", F.col("pos").cast("long").alias("pos"), "tok")
    buckets = docs.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.sum(F.size("toks")), F.lit(0)) / BUCKET_ROWS)).alias("nb"))
    t = t.join(F.broadcast(buckets)).withColumn("b", draw(F.col("nb"), F.lit("b"), F.col("doc_id"), F.col("pos")))
    # both orders of a bucket come from one move of its rows; a place and the word of its rank meet where the bucket is
    key = lambda name: F.unhex(F.md5(F.concat_ws("|", F.lit(name), F.col("doc_id").cast("string"), F.col("pos").cast("string"))))
    rank = lambda name: F.row_number().over(Window.partitionBy("b").orderBy(key(name), "doc_id", "pos"))
    none = lambda kind: F.lit(None).cast(kind)
    place = F.struct("kt", "doc_id", "pos", none("string").alias("tok"))
    word = F.struct(F.col("kf").alias("kt"), none("long").alias("doc_id"), none("long").alias("pos"), "tok")
    both = t.repartition("b").withColumn("kt", rank("t")).withColumn("kf", rank("f")).select("b", F.inline(F.array(place, word)))
    dealt = both.groupBy("b", "kt").agg(F.max("doc_id").alias("doc_id"), F.max("pos").alias("pos"), F.max("tok").alias("tok"))
    mixed = dealt.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("toks"))
    known = reference_bigrams(spark, sf).select("w1", "w2")
    sides = [nulls.known_neighbours(x.select("toks"), known).select(F.lit(kind).alias("kind"), "pairs", "known") for kind, x in (("corpus", docs), ("shuffled", mixed))]
    return sides[0].unionByName(sides[1]).where("pairs > 0")


_HITS = f"hits AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({skeleton('tok')} IN (SELECT skel FROM known)) AS h FROM tokens GROUP BY 1)"


def _hits(spark, sf):
    """(doc_id, n, h): words of each document, and those whose skeleton the dictionary has; skeletons are made once a type."""
    known = dictionary(spark, sf).select(ft.skeleton(F.col("word")).alias("skel")).where("skel <> ''").distinct().withColumn("hit", F.lit(1))
    counts = stats.word_counts(token_docs(spark, sf), "doc_id")
    types = counts.select("tok").distinct().withColumn("skel", ft.skeleton(F.col("tok"))).join(known, "skel", "left_semi").select("tok", F.lit(1).alias("hit"))
    x = counts.join(types, "tok", "left")
    return x.groupBy("doc_id").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("c")).otherwise(0)).alias("h"))


_RUNS = f"""WITH {TOKENS}, {DICT}, {_KNOWN}, {_HITS}, run AS (SELECT unnest(range(50)) AS run), x AS (
SELECT run, sum(h) * 1.0 / sum(n) AS rate FROM hits, run WHERE {draw_sql(10, "'r'", 'run', 'doc_id')} <> 0 GROUP BY 1), whole AS (SELECT sum(h) * 1.0 / sum(n) AS rate FROM hits)"""


@query(_RUNS + " SELECT run, round(x.rate, 6) AS rate FROM x")
def bootstrap_runs(spark, sf):
    """The rate of matched words in fifty runs that each leave out a tenth of the documents."""
    return _runs(spark, sf).withColumn("rate", r6(F.col("rate")))


def _runs(spark, sf):
    x = _hits(spark, sf).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(49))))
    return x.where(draw(10, F.lit("r"), F.col("run"), F.col("doc_id")) != 0).groupBy("run").agg((F.sum("h") / F.sum("n")).alias("rate"))


@query(_RUNS + """ SELECT round(avg(x.rate), 6) AS mean, round(stddev_pop(x.rate), 8) AS sd, round(quantile_cont(x.rate, 0.025), 6) AS low, round(quantile_cont(x.rate, 0.975), 6) AS high,
round(avg(CASE WHEN x.rate <= whole.rate THEN 1.0 ELSE 0.0 END), 6) AS percentile FROM x, whole""")
def bootstrap_confidence(spark, sf):
    """Mean, spread and 95 % interval of the runs, and where the whole corpus lies among them."""
    whole = _hits(spark, sf).agg((F.sum("h") / F.sum("n")).alias("whole"))
    x = _runs(spark, sf).join(F.broadcast(whole))
    q = lambda p: r6(F.percentile("rate", F.lit(p)))
    return x.agg(
        r6(F.avg("rate")).alias("mean"), F.round(F.stddev_pop("rate"), 8).alias("sd"), q(0.025).alias("low"), q(0.975).alias("high"),
        r6(F.avg(F.when(F.col("rate") <= F.col("whole"), 1.0).otherwise(0.0))).alias("percentile"),
    )


_LANGDICT = "ld AS (SELECT lang, tok FROM (SELECT lang, tok, row_number() OVER (PARTITION BY lang ORDER BY c DESC, tok) AS k FROM (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2)) WHERE k <= 200)"


@query(f"""WITH {TOKENS}, {_LANGDICT}, lc AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2), tot AS (SELECT lang, sum(c) AS n FROM lc GROUP BY 1)
SELECT lc.lang, ld.lang AS dictionary, round(sum(lc.c) * 1.0 / max(tot.n), 6) AS rate FROM lc JOIN ld ON ld.tok = lc.tok JOIN tot ON tot.lang = lc.lang GROUP BY 1, 2""")
def polyglot_rates(spark, sf):
    """Share of each language's words among the 200 most frequent of each language: does any dictionary do?"""
    lc = stats.word_counts(token_docs(spark, sf), "lang")
    w = Window.partitionBy("lang").orderBy(F.desc("c"), "tok")
    ld = lc.withColumn("k", F.row_number().over(w)).where("k <= 200").select(F.col("lang").alias("dictionary"), "tok")
    tot = lc.groupBy("lang").agg(F.sum("c").alias("total"))
    x = lc.join(ld, "tok").groupBy("lang", "dictionary").agg(F.sum("c").alias("c")).join(tot, "lang")
    return x.select("lang", "dictionary", r6(F.col("c") / F.col("total")).alias("rate"))


@query(f"""WITH {TOKENS}, {DICT}, {_TYPES}, dom AS (SELECT DISTINCT item_id % 2 AS domain, {skeleton('tok')} AS skel FROM btok), ts AS (SELECT {skeleton('tok')} AS skel, c FROM types)
SELECT domain, round(sum(ts.c) * 1.0 / (SELECT sum(c) FROM types), 6) AS rate FROM ts JOIN dom ON dom.skel = ts.skel WHERE ts.skel <> '' GROUP BY 1""")
def domain_swap(spark, sf):
    """The rate of matched words with the dictionary of either half of the reference texts."""
    from stratalex.sources.tables import reference_docs

    ts = stats.word_counts(token_docs(spark, sf)).withColumn("skel", ft.skeleton(F.col("tok")))
    dom = reference_docs(spark, sf).select((F.col("item_id") % 2).alias("domain"), F.explode("toks").alias("word")).distinct()
    dom = dom.select("domain", ft.skeleton(F.col("word")).alias("skel")).where("skel <> ''").distinct()
    total = ts.agg(F.sum("c").alias("total"))
    x = ts.groupBy("skel").agg(F.sum("c").alias("c")).join(dom, "skel").groupBy("domain").agg(F.sum("c").alias("c"))
    return x.join(F.broadcast(total)).select("domain", r6(F.col("c") / F.col("total")).alias("rate"))


_COLL = "translate(tok, 'kqgdbvfzxyw', 'ccctpppsiiu')"


@query(f"""WITH {TOKENS}, {DICT}, {_TYPES}, dw AS (SELECT DISTINCT word FROM dict), dc AS (SELECT DISTINCT {_COLL.replace('tok', 'word')} AS word FROM dict),
x AS (SELECT count(*) AS n, count(*) FILTER (tok IN (SELECT word FROM dw)) AS a FROM types), y AS (SELECT count(*) AS n, count(*) FILTER (tok IN (SELECT word FROM dc)) AS a FROM (SELECT DISTINCT {_COLL} AS tok FROM types))
SELECT x.n AS types, y.n AS collapsed, x.a AS hits, y.a AS collapsed_hits,
round((x.n + y.n) * pow(x.a * (y.n - y.a) * 1.0 - y.a * (x.n - x.a) * 1.0, 2) / nullif((x.a + y.a) * 1.0 * (x.n - x.a + y.n - y.a) * x.n * y.n, 0), 4) AS chi2 FROM x, y""")
def collapsed_alphabet(spark, sf):
    """Types and dictionary hits before and after like letters are made one, with the chi-squared of the two tables."""
    src, dst = "kqgdbvfzxyw", "ccctpppsiiu"
    types, words = stats.word_counts(token_docs(spark, sf)).select("tok"), dictionary(spark, sf).select(F.col("word").alias("tok"))

    def count(t, w, n, a):
        x = t.join(w.distinct().withColumn("hit", F.lit(1)), "tok", "left")
        return x.agg(F.count(F.lit(1)).alias(n), F.count("hit").alias(a))

    low = F.translate("tok", src, dst).alias("tok")
    x, y = count(types, words, "types", "hits"), count(types.select(low).distinct(), words.select(low), "collapsed", "collapsed_hits")
    n, m, a, b = F.col("types"), F.col("collapsed"), F.col("hits"), F.col("collapsed_hits")
    cross = (a * (m - b)).cast("double") - (b * (n - a)).cast("double")
    chi = F.try_divide((n + m) * cross * cross, (a + b).cast("double") * (n - a + m - b) * n * m)
    return x.join(F.broadcast(y)).select("types", "collapsed", "hits", "collapsed_hits", F.round(chi, 4).alias("chi2"))


# composed analyses


@query(f"""WITH {TOKENS}, c AS (SELECT source, k.kind, CASE k.kind WHEN 'prefix' THEN left(tok, 2) ELSE right(tok, 2) END AS affix, count(*) AS n FROM tokens, (SELECT unnest(['prefix', 'suffix']) AS kind) k GROUP BY 1, 2, 3)
SELECT source, kind, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h, count(*) AS affixes FROM c GROUP BY 1, 2""")
def affix_entropy_by_section(spark, sf):
    """Entropy of the first and the last two letters by source."""
    c = stats.word_counts(token_docs(spark, sf), "source")
    both = F.array(*(F.struct(F.lit(k).alias("kind"), f("tok", F.lit(2)).alias("affix")) for k, f in (("prefix", F.left), ("suffix", F.right))))
    n = c.select("source", "c", F.inline(both)).groupBy("source", "kind", "affix").agg(F.sum("c").alias("n"))
    return n.groupBy("source", "kind").agg(r6(stats.bits("n")).alias("h"), F.count(F.lit(1)).alias("affixes"))


def _h1_change_sql(expr):
    one = "SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, ch, sum(c) AS n FROM (SELECT lang, c, unnest(string_split({0}, '')) AS ch FROM lt WHERE {0} <> '') GROUP BY 1, 2) GROUP BY 1"
    return f"WITH {TOKENS}, lt AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2), a AS ({one.format('tok')}), b AS ({one.format(expr)}) SELECT lang, round(a.h, 6) AS h1, round(b.h - a.h, 6) AS change FROM a JOIN b USING (lang)"


def _h1_change(spark, sf, f):
    """Entropy of letters by language, and its change when each word is rewritten; words are rewritten once a type."""
    t = stats.word_counts(token_docs(spark, sf), "lang")

    def h(word, name):
        chars = t.select("lang", "c", F.explode(F.filter(F.split(word, ""), lambda x: x != "")).alias("ch")).groupBy("lang", "ch").agg(F.sum("c").alias("n"))
        return chars.groupBy("lang").agg(stats.bits("n").alias(name))

    return h(F.col("tok"), "a").join(h(f(F.col("tok")), "b"), "lang").select("lang", r6(F.col("a")).alias("h1"), r6(F.col("b") - F.col("a")).alias("change"))


_CORE = "^(un|re|in|con|de|pre)|(ing|ed|er|ly|es|en)$"


@query(_h1_change_sql(f"regexp_replace(tok, '{_CORE}', '', 'g')"))
def core_isolation(spark, sf):
    """Entropy of letters once customary beginnings and ends are stripped."""
    return _h1_change(spark, sf, lambda t: F.regexp_replace(t, _CORE, ""))


@query(_h1_change_sql("replace(tok, 'qu', 'q')"))
def substitution_effect(spark, sf):
    """Entropy of letters once a pair of letters is read as one."""
    return _h1_change(spark, sf, lambda t: F.replace(t, F.lit("qu"), F.lit("q")))


@query(f"""WITH {TOKENS}, {DICT}, g AS (SELECT tok, min(source) AS source, count(*) AS c FROM tokens GROUP BY 1 HAVING count(DISTINCT source) = 1)
SELECT g.source, g.tok, g.c, dict.freq FROM g JOIN dict ON dict.word = g.tok""")
def crib_constraints(spark, sf):
    """Words of one source alone that the reference vocabulary has: cribs for that source."""
    s = stats.word_counts(token_docs(spark, sf), "source")
    g = s.groupBy("tok").agg(F.min("source").alias("source"), F.count("source").alias("k"), F.sum("c").alias("c")).where("k = 1")
    return g.join(dictionary(spark, sf).withColumnRenamed("word", "tok"), "tok").select("source", "tok", "c", "freq")


@query(f"""WITH {TOKENS}, o AS (SELECT source, left(tok, 2) AS onset, count(*) AS c FROM tokens GROUP BY 1, 2), al AS (SELECT onset, sum(c) AS n FROM o GROUP BY 1),
top AS (SELECT onset FROM al ORDER BY n DESC, onset LIMIT 1)
SELECT source, onset, c, onset = (SELECT onset FROM top) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, onset) AS k FROM o) WHERE k = 1""")
def dominant_onset(spark, sf):
    """The commonest beginning of words in each source, and whether it is that of all."""
    o = stats.word_counts(token_docs(spark, sf), "source").groupBy("source", F.left("tok", F.lit(2)).alias("onset")).agg(F.sum("c").alias("c"))
    top = o.groupBy("onset").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "onset").limit(1).select(F.col("onset").alias("whole"))
    w = Window.partitionBy("source").orderBy(F.desc("c"), "onset")
    return o.withColumn("k", F.row_number().over(w)).where("k = 1").join(F.broadcast(top)).select("source", "onset", "c", (F.col("onset") == F.col("whole")).alias("expected"))


# Marker words of six groups.
_MARKERS = {"article": ["the", "a", "an"], "join": ["and", "or", "but"], "place": ["in", "on", "at"], "from": ["of", "from", "by"], "verb": ["is", "was", "are"], "deny": ["not", "no", "never"]}


@query(f"""WITH {TOKENS} SELECT doc_id, {' + '.join(f"CAST(list_has_any(toks, {v}) AS INT)" for v in _MARKERS.values())} AS found,
{' + '.join(f"CAST(list_has_any(toks, {v}) AS INT)" for v in _MARKERS.values())} >= 3 AS consistent FROM d""")
def structure_check(spark, sf):
    """How many of six groups of marker words a document has; three make it consistent."""
    found = [F.arrays_overlap("toks", F.array(*map(F.lit, v))).cast("int") for v in _MARKERS.values()]
    n = sum(found[1:], found[0])
    return token_docs(spark, sf).select("doc_id", n.alias("found"), (n >= 3).alias("consistent"))


_BYLEN = "SELECT {0} AS g, length(tok) AS len, count(*) AS n FROM tokens GROUP BY 1, 2"
_BYCH = "SELECT {0} AS g, ch, count(*) AS n FROM (SELECT {0}, unnest(string_split(tok, '')) AS ch FROM tokens) GROUP BY 1, 2"


@query(f"""WITH {TOKENS}, sc AS (SELECT g, ch, n * 1.0 / sum(n) OVER (PARTITION BY g) AS p FROM ({_BYCH.format('source')})), lc AS (SELECT g, ch, n * 1.0 / sum(n) OVER (PARTITION BY g) AS p FROM ({_BYCH.format('lang')})),
sl AS (SELECT g, len, n * 1.0 / sum(n) OVER (PARTITION BY g) AS p FROM ({_BYLEN.format('source')})), ll AS (SELECT g, len, n * 1.0 / sum(n) OVER (PARTITION BY g) AS p FROM ({_BYLEN.format('lang')})),
c AS (SELECT a.g AS s, b.g AS l, sum(least(a.p, b.p)) AS o FROM sc a JOIN lc b ON a.ch = b.ch GROUP BY 1, 2), e AS (SELECT a.g AS s, b.g AS l, sum(least(a.p, b.p)) AS o FROM sl a JOIN ll b ON a.len = b.len GROUP BY 1, 2)
SELECT c.s AS source, c.l AS lang, round(0.7 * c.o + 0.3 * (1 - e.o), 6) AS score FROM c JOIN e ON c.s = e.s AND c.l = e.l""")
def plaintext_matching(spark, sf):
    """Sources against languages: 0.7 of what letter shares have in common and 0.3 of what word lengths have not."""
    docs = token_docs(spark, sf)

    def shares(key):
        t = stats.word_counts(docs, key).withColumnRenamed(key, "g")
        w = Window.partitionBy("g")
        ch = t.select("g", "c", F.explode(F.filter(F.split("tok", ""), lambda x: x != "")).alias("v")).groupBy("g", "v").agg(F.sum("c").alias("n"))
        ln = t.groupBy("g", F.length("tok").alias("v")).agg(F.sum("c").alias("n"))
        return [x.withColumn("p", F.col("n") / F.sum("n").over(w)) for x in (ch, ln)]

    def overlap(a, b, name):
        x = a.select("v", F.col("g").alias("source"), F.col("p").alias("pa")).join(b.select("v", F.col("g").alias("lang"), F.col("p").alias("pb")), "v")
        return x.groupBy("source", "lang").agg(F.sum(F.least("pa", "pb")).alias(name))

    (sc, sl), (lc, ll) = shares("source"), shares("lang")
    x = overlap(sc, lc, "c").join(overlap(sl, ll, "e"), ["source", "lang"])
    return x.select("source", "lang", r6(0.7 * F.col("c") + 0.3 * (1 - F.col("e"))).alias("score"))


@query(f"""WITH {TOKENS}, lt AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2), s AS (SELECT lang, c, log2(sum(c) OVER (PARTITION BY lang) * 1.0 / c) AS v FROM lt),
m AS (SELECT lang, c, v, min(v) OVER (PARTITION BY lang) AS lo, max(v) OVER (PARTITION BY lang) AS hi FROM s), b AS (SELECT lang, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor(round((v - lo) / (hi - lo) * 10, 9)) AS INT), 9) END AS bin, sum(c) AS n FROM m GROUP BY 1, 2)
SELECT lang, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h, count(*) AS bins FROM b GROUP BY 1""")
def surprisal_histogram(spark, sf):
    """Entropy of a histogram of ten bins of the words' surprisal; the last bin is closed. Words of one count share a bin."""
    c = stats.word_counts(token_docs(spark, sf), "lang").groupBy("lang", "c").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("lang")
    v = c.withColumn("v", F.log2(F.sum(F.col("c") * F.col("k")).over(w) / F.col("c")))
    m = v.withColumn("lo", F.min("v").over(w)).withColumn("hi", F.max("v").over(w))
    part = F.round(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 10, 9)
    bin_ = F.coalesce(F.least(F.floor(part), F.lit(9)), F.lit(0))
    n = m.groupBy("lang", bin_.alias("bin")).agg(F.sum(F.col("c") * F.col("k")).alias("n"))
    return n.groupBy("lang").agg(r6(stats.bits("n")).alias("h"), F.count(F.lit(1)).alias("bins"))


@query(f"""WITH {TOKENS}, s AS (SELECT source, tok, count(*) AS c FROM tokens GROUP BY 1, 2), p AS (SELECT source, i, substr(tok, CAST(i + 1 AS BIGINT), 1) AS ch, sum(c) AS n FROM s, range(10) r(i) WHERE i < length(tok) GROUP BY 1, 2, 3),
h AS (SELECT source, i, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM p GROUP BY 1, 2)
SELECT i AS position, count(*) AS sources, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS sd FROM h GROUP BY 1""")
def curve_atlas(spark, sf):
    """Mean and spread over sources of the entropy of letters at each of ten places in words."""
    s = stats.word_counts(token_docs(spark, sf), "source")
    p = s.select("source", "c", F.posexplode(F.slice(F.filter(F.split("tok", ""), lambda x: x != ""), 1, 10)).alias("i", "ch"))
    h = p.groupBy("source", "i", "ch").agg(F.sum("c").alias("n")).groupBy("source", "i").agg(stats.bits("n").alias("h"))
    return h.groupBy(F.col("i").cast("long").alias("position")).agg(F.count(F.lit(1)).alias("sources"), r6(F.avg("h")).alias("mean"), r6(F.stddev_pop("h")).alias("sd"))


@query(f"""WITH {TOKENS}, f AS (SELECT doc_id, pos, count(*) FILTER (tok IN ('the', 'a', 'of', 'and', 'in', 'to')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM tokens)
SELECT doc_id, max(n) AS most, count(*) FILTER (n > 8) AS dense FROM f GROUP BY 1""")
def function_word_density(spark, sf):
    """Function words among the twenty before each word: the most, and how many words follow over eight."""
    docs = token_docs(spark, sf).where(F.size("toks") > 0)
    flags = F.transform("toks", lambda t: t.isin("the", "a", "of", "and", "in", "to").cast("long"))
    rows = docs.select("doc_id", F.posexplode(flags).alias("pos", "f"))
    n = F.coalesce(F.sum("f").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-20, -1)), F.lit(0))
    return rows.select("doc_id", n.alias("n")).groupBy("doc_id").agg(F.max("n").alias("most"), F.sum((F.col("n") > 8).cast("long")).alias("dense"))


@query(f"""WITH {TOKENS}, c AS (SELECT lang, tok, count(*) AS n FROM tokens GROUP BY 1, 2), x AS (SELECT lang, sum(n) AS words, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY 1)
SELECT lang, CAST(words AS BIGINT) AS words, round(h, 6) AS h_word, round(words * h, 2) AS bits, CAST(ceil(pow(2, h)) AS BIGINT) AS states FROM x""")
def information_budget(spark, sf):
    """Bits that a language's words can carry, and the least number of states a machine needs for their entropy."""
    x = stats.word_counts(token_docs(spark, sf), "lang").groupBy("lang").agg(F.sum("c").alias("words"), stats.bits("c").alias("h"))
    return x.select("lang", "words", r6(F.col("h")).alias("h_word"), F.round(F.col("words") * F.col("h"), 2).alias("bits"), F.ceil(F.pow(F.lit(2.0), F.col("h"))).alias("states"))


@query(f"""WITH {TOKENS}, c AS (SELECT lang, tok, count(*) AS n FROM tokens GROUP BY 1, 2), g AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) * 1.0 / sum(n) AS ttr FROM c GROUP BY 1),
t AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) * 1.0 / sum(n) AS ttr FROM (SELECT tok, sum(n) AS n FROM c GROUP BY 1))
SELECT lang, round(g.h - t.h, 6) AS dh, round(g.ttr - t.ttr, 6) AS dttr, CASE WHEN abs(g.h - t.h) >= 0.2 * t.h THEN 'YES' WHEN abs(g.h - t.h) >= 0.1 * t.h THEN 'WEAK' ELSE 'NO' END AS discriminates FROM g, t""")
def group_against_all(spark, sf):
    """Each language's entropy and type ratio against the whole corpus, with a verdict on the size of the effect."""
    c = stats.word_counts(token_docs(spark, sf), "lang")
    both = lambda h, r: (stats.bits("c").alias(h), (F.count(F.lit(1)) / F.sum("c")).alias(r))
    g = c.groupBy("lang").agg(*both("h", "ttr"))
    t = c.groupBy("tok").agg(F.sum("c").alias("c")).agg(*both("th", "tttr"))
    gap = F.abs(F.col("h") - F.col("th"))
    verdict = F.when(gap >= 0.2 * F.col("th"), "YES").when(gap >= 0.1 * F.col("th"), "WEAK").otherwise("NO")
    return g.join(F.broadcast(t)).select("lang", r6(F.col("h") - F.col("th")).alias("dh"), r6(F.col("ttr") - F.col("tttr")).alias("dttr"), verdict.alias("discriminates"))


# What natural texts keep to.
_RANGES = {"h1": (3.5, 4.5), "h2": (2.8, 4.0), "exponent": (0.5, 1.5), "avg_len": (3.0, 7.0)}


def _naturalness_sql():
    from stratalex.plans.statistics import _PROFILE

    n = " + ".join(f"CAST({c} BETWEEN {a} AND {b} AS INT)" for c, (a, b) in _RANGES.items())
    return f"{_PROFILE} SELECT lang, ({n}) / 4.0 AS score, ({n}) / 4.0 >= 0.75 AS natural_text FROM prof"


@query(_naturalness_sql())
def naturalness(spark, sf):
    """Share of four measures within the ranges of natural texts; three of four pass."""
    hit = [F.col(c).between(a, b).cast("int") for c, (a, b) in _RANGES.items()]
    score = sum(hit[1:], hit[0]) / 4.0
    return profile(spark, sf).select("lang", score.alias("score"), (score >= 0.75).alias("natural_text"))


@query(f"""WITH {TOKENS}, {DICT}, {_KNOWN}, s AS (SELECT doc_id, pos, tok, {skeleton('tok')} AS skel FROM tokens), second AS (SELECT doc_id, pos, tok FROM s WHERE skel IN (SELECT skel FROM known)), first AS (SELECT doc_id, pos, tok FROM tokens WHERE tok IN (SELECT word FROM dict))
SELECT t.doc_id, count(*) AS n, count(f.tok) AS from_first, count(*) FILTER (f.tok IS NULL AND g.tok IS NOT NULL) AS from_second FROM tokens t LEFT JOIN second g ON g.doc_id = t.doc_id AND g.pos = t.pos LEFT JOIN first f ON f.doc_id = t.doc_id AND f.pos = t.pos GROUP BY 1""")
def resolved_merge(spark, sf):
    """Two readings of the same places merged, the exact one first: how many words come from which; decided once a type."""
    counts = stats.word_counts(token_docs(spark, sf), "doc_id")
    words = dictionary(spark, sf).select(F.col("word").alias("tok"))
    skels = words.select(ft.skeleton(F.col("tok")).alias("skel")).where("skel <> ''").distinct()
    types = counts.select("tok").distinct().withColumn("skel", ft.skeleton(F.col("tok")))
    types = types.join(words.withColumn("first", F.lit(1)), "tok", "left").join(skels.withColumn("second", F.lit(1)), "skel", "left").select("tok", "first", "second")
    x = counts.join(types, "tok")
    n = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    return x.groupBy("doc_id").agg(F.sum("c").alias("n"), n(F.col("first") == 1).alias("from_first"), n(F.col("first").isNull() & (F.col("second") == 1)).alias("from_second"))


@query("""SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS sd, round(avg(n_chars) / (SELECT avg(n_chars) FROM documents), 6) AS ratio FROM documents GROUP BY 1""")
def length_ratio(spark, sf):
    """Lengths of documents by source against those of all."""
    d = table(spark, sf, "documents").select("source", "n_chars")
    whole = d.agg(F.avg("n_chars").alias("all"))
    x = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    return x.join(F.broadcast(whole)).select("source", "n", F.round("m", 4).alias("mean"), F.round("s", 4).alias("sd"), r6(F.col("m") / F.col("all")).alias("ratio"))


#: Seeds of each setting for each hundred documents, and words of a text.
MODEL_TEXTS, MODEL_WORDS = 1, 500


@query()
def model_scores(spark, sf):
    """Every model under every setting of its grid, generated by SQL and judged against the corpus: entropy, type-token ratio and exponent near it, and the model's own test."""
    ship_package(spark)
    docs = token_docs(spark, sf)
    generative.register_sql(spark)
    seeds = MODEL_TEXTS * (docs.count() // 100 + 1)
    each = " UNION ALL ".join(f"SELECT m.model, m.params, s.id, g.pos, g.word FROM (SELECT '{name}' AS model, params FROM model_grid('{name}')) m JOIN s, LATERAL generated('{name}', m.params, s.id, {MODEL_WORDS}) g" for name in sorted(generative.MODELS))
    rows = spark.sql(f"WITH s AS (SELECT id FROM range({seeds})) {each}")
    texts = rows.groupBy("model", "params", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("toks"))
    made = generative.profiles(texts.select(F.concat_ws(" ", "model", "params").alias("run"), "toks"))
    target = generative.profiles(docs.select(F.lit("corpus").alias("run"), "toks")).first()
    made, _ = materialize(made, "model-profiles")
    made.createOrReplaceTempView("model_profiles")
    zero = ", ".join(f"CAST({target[k] if target else 0.0} AS DOUBLE)" for k in ("h2", "ttr", "exponent"))
    scored = spark.sql(f"SELECT p.run, p.h2, p.ttr, p.exponent, p.h1, p.h3, s.distance, s.near FROM model_profiles p, LATERAL quick_score(p.h2, p.ttr, p.exponent, {zero}) s")
    rows = [(*r.run.split(" ", 1), *(float(round(r[k] or 0.0, 6)) for k in ("h2", "ttr", "exponent", "distance")), r.near, generative.passes(r.run.split(" ", 1)[0], r)) for r in scored.collect()]  # one row a setting
    return spark.createDataFrame(rows, "model string, params string, h2 double, ttr double, exponent double, distance double, near boolean, passes boolean")
