"""Queries of orders of documents, clusters, permutations of whole documents, ablation and further composed analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as ft
from stratalex.operators import matching as m
from stratalex.operators import search, stats
from stratalex.plans.analyses import _LEX, lexicon
from stratalex.plans.matching import _BASE, _FUZZY, _index, _types
from stratalex.plans.models import draw, draw_sql
from stratalex.plans.registry import query
from stratalex.plans.sqltext import DICT, TOKENS, pos_tag, skeleton
from stratalex.plans.statistics import _DOCH, RANGE, doc_entropies
from stratalex.session import ship_package
from stratalex.sources.tables import dictionary, explode_tokens, neighbours, reference_docs, token_docs

r6 = lambda c: F.round(c, 6)

#: Orders of sources that are compared, each by a key of a source's number k (from 0, by name): as it is, backwards, even ones first, in threes.
ORDERS = {"current": "k", "reversed": "-k", "even_first": "k % 2 * 1000000 + k", "thirds": "k % 3 * 1000000 + k"}
_SRC = f"""src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM documents)),
ord AS ({" UNION ALL ".join(f"SELECT '{name}' AS order_id, source, row_number() OVER (ORDER BY {key}) AS place FROM src" for name, key in ORDERS.items())})"""


def _orders(spark, sf):
    """(order_id, source, place): one row a source and order; the lists are short, as there is a row for each source."""
    src = token_docs(spark, sf).select("source").distinct().withColumn("k", F.row_number().over(Window.orderBy("source")) - 1)
    keys = F.array(*(F.struct(F.lit(name).alias("order_id"), F.expr(key).alias("key")) for name, key in ORDERS.items()))
    each = src.select("source", F.inline(keys))
    return each.select("order_id", "source", F.row_number().over(Window.partitionBy("order_id").orderBy("key")).alias("place"))


@query(f"""WITH {_SRC} SELECT order_id, doc_id, row_number() OVER (PARTITION BY order_id ORDER BY place, doc_id) AS seq FROM documents JOIN ord USING (source)""")
def order_by_list(spark, sf):
    """The place of every document under each order of the sources.

    No order is one sort of all documents: rows of a range of ids are counted
    first, and a document's place is its rank in its range beyond those before.
    """
    docs = token_docs(spark, sf).select("doc_id", "source", F.floor(F.col("doc_id") / RANGE).alias("block"))
    sizes = docs.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n")).join(_orders(spark, sf), "source")
    w = Window.partitionBy("order_id").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("order_id", "source", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    ranked = docs.withColumn("r", F.row_number().over(Window.partitionBy("source", "block").orderBy("doc_id")))
    return ranked.join(starts, ["source", "block"]).select("order_id", "doc_id", (F.col("start") + F.col("r")).alias("seq"))


@query(f"""WITH {TOKENS}, {_DOCH}, {_SRC}, s AS (SELECT order_id, h1, h2, lag(h1) OVER w AS a1, lag(h2) OVER w AS a2 FROM dh JOIN ord USING (source) WINDOW w AS (PARTITION BY order_id ORDER BY place, doc_id)),
o AS (SELECT order_id, 0.4 * avg(abs(h1 - a1)) + 0.6 * avg(abs(h2 - a2)) AS drift, count(a1) AS steps FROM s GROUP BY 1)
SELECT order_id, round(drift, 6) AS drift, steps FROM o""")
def order_comparison(spark, sf):
    """How much entropy changes from each document to the next under each order of the sources; less is more consistent.

    Orders move whole sources, so what changes within them is added up once;
    only the documents at the borders of ranges and sources are put in order.
    """
    h = doc_entropies(spark, sf, "source").select("source", "doc_id", F.floor(F.col("doc_id") / RANGE).alias("block"), F.struct("h1", "h2").alias("h"))
    delta = lambda a, b, k: F.abs(F.col(f"{b}.{k}") - F.col(f"{a}.{k}"))
    own = Window.partitionBy("source", "block").orderBy("doc_id")
    inner = h.select(F.lag("h").over(own).alias("a"), F.col("h").alias("b")).where("a is not null")
    sums = [F.sum(delta("a", "b", "h1")).alias("d1"), F.sum(delta("a", "b", "h2")).alias("d2"), F.count(F.lit(1)).alias("n")]
    inner = inner.agg(*sums).select(*(F.coalesce(c, F.lit(0)).alias(f"in_{c}") for c in ("d1", "d2", "n")))
    ends = h.groupBy("source", "block").agg(F.min(F.struct("doc_id", "h")).alias("head"), F.max(F.struct("doc_id", "h")).alias("tail"))
    w = Window.partitionBy("order_id").orderBy("place", "block")
    edge = ends.join(_orders(spark, sf), "source").select("order_id", F.lag("tail.h").over(w).alias("a"), F.col("head.h").alias("b")).where("a is not null")
    x = edge.groupBy("order_id").agg(*sums).join(F.broadcast(inner))
    steps = F.col("n") + F.col("in_n")
    drift = 0.4 * (F.col("d1") + F.col("in_d1")) / steps + 0.6 * (F.col("d2") + F.col("in_d2")) / steps
    return x.select("order_id", r6(drift).alias("drift"), steps.alias("steps"))


@query(f"""WITH {TOKENS}, {_SRC}, nx AS (SELECT source, ch AS c1, lead(ch) OVER (PARTITION BY doc_id ORDER BY i) AS c2 FROM (
SELECT doc_id, source, unnest(string_split(array_to_string(toks, ''), '')) AS ch, unnest(range(length(array_to_string(toks, '')))) AS i FROM d WHERE len(toks) > 0)),
j AS (SELECT source, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT source, c1, c2, count(*) AS n FROM nx WHERE c2 IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
x AS (SELECT source, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT source, c1, count(*) AS n FROM nx WHERE c2 IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT src.source, k, j.h - x.h AS h2 FROM src JOIN j USING (source) JOIN x USING (source)), v AS (SELECT DISTINCT k, tok FROM tokens JOIN src USING (source)),
n AS (SELECT k, count(*) AS types FROM v GROUP BY 1), c AS (SELECT a.k + 1 AS k, count(*) AS shared FROM v a JOIN v b ON b.tok = a.tok AND b.k = a.k + 2 GROUP BY 1)
SELECT s.source AS missing, round(abs(b.h2 - a.h2), 6) AS jump, round(coalesce(c.shared, 0) * 1.0 / (na.types + nb.types - coalesce(c.shared, 0)), 6) AS overlap
FROM src s JOIN e a ON a.k = s.k - 1 JOIN e b ON b.k = s.k + 1 JOIN n na ON na.k = a.k JOIN n nb ON nb.k = b.k LEFT JOIN c ON c.k = s.k""")
def boundary_gap(spark, sf):
    """For each source, as if it were missing: the jump of entropy from the source before to the one after, and what vocabulary both share."""
    src = _orders(spark, sf).where("order_id = 'current'").select("source", (F.col("place") - 1).alias("k"))
    h = stats.char_entropies(stats.char_grams(token_docs(spark, sf), "source"), "source").join(src, "source").select("k", "source", "h2")
    v = explode_tokens(token_docs(spark, sf)).select("source", "tok").distinct().join(src, "source").select("k", "tok")
    n = v.groupBy("k").agg(F.count(F.lit(1)).alias("types"))
    shared = v.select(F.col("k").alias("a"), "tok").join(v.select((F.col("k") - 2).alias("a"), "tok"), ["a", "tok"]).groupBy((F.col("a") + 1).alias("k")).agg(F.count(F.lit(1)).alias("shared"))
    side = h.join(n, "k")
    before = side.select((F.col("k") + 1).alias("k"), F.col("h2").alias("ha"), F.col("types").alias("na"))
    after = side.select((F.col("k") - 1).alias("k"), F.col("h2").alias("hb"), F.col("types").alias("nb"))
    x = src.join(before, "k").join(after, "k").join(shared, "k", "left").withColumn("s", F.coalesce("shared", F.lit(0)))
    return x.select(F.col("source").alias("missing"), r6(F.abs(F.col("hb") - F.col("ha"))).alias("jump"), r6(F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("overlap"))


_NEAR = f"""cl AS (SELECT word, field FROM lex), cw AS (SELECT doc_id, pos, tok, field FROM tokens JOIN cl ON cl.word = tok),
pr AS (SELECT a.tok AS w1, a.field AS f1, b.tok AS w2, b.field AS f2 FROM cw a JOIN cw b ON b.doc_id = a.doc_id AND b.pos IN (a.pos + 1, a.pos + 2) WHERE a.tok <> b.tok)"""


@query(f"""WITH {TOKENS}, {DICT}, {_LEX}, {_NEAR}, f AS (SELECT field, count(*) AS n FROM cl WHERE word IN (SELECT tok FROM cw) GROUP BY 1),
t AS (SELECT count(*) FILTER (f1 = f2) * 2 AS inside, count(*) FILTER (f1 <> f2) * 2 AS across FROM pr), c AS (SELECT sum(n * (n - 1)) AS within, sum(n) * sum(n) - sum(n * n) AS between FROM f)
SELECT round(inside * 1.0 / greatest(within, 1), 8) AS within_density, round(across * 1.0 / greatest(between, 1), 8) AS between_density,
round((inside * 1.0 / greatest(within, 1)) / greatest(across * 1.0 / greatest(between, 1), 1e-10), 6) AS ratio, (inside * 1.0 / greatest(within, 1)) / greatest(across * 1.0 / greatest(between, 1), 1e-10) > 1.5 AS coherent FROM t, c""")
def cluster_coherence(spark, sf):
    """How much oftener words of one field stand within two places of each other than words of different fields."""
    pairs, fields = _field_pairs(spark, sf)
    total = pairs.agg(F.sum(F.when(F.col("f1") == F.col("f2"), F.col("n")).otherwise(0) * 2).alias("inside"), F.sum(F.when(F.col("f1") != F.col("f2"), F.col("n")).otherwise(0) * 2).alias("across"))
    n = F.col("n")
    cells = fields.groupBy("field").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1)).alias("within"), (F.sum(n) * F.sum(n) - F.sum(n * n)).alias("between"))
    a = F.coalesce("inside", F.lit(0)) / F.greatest(F.col("within"), F.lit(1))
    b = F.coalesce("across", F.lit(0)) / F.greatest(F.col("between"), F.lit(1))
    ratio = a / F.greatest(b, F.lit(1e-10))
    return total.join(F.broadcast(cells)).select(F.round(a, 8).alias("within_density"), F.round(b, 8).alias("between_density"), r6(ratio).alias("ratio"), (ratio > 1.5).alias("coherent"))


def _field_pairs(spark, sf):
    """((w1, f1, w2, f2, n) of words of the fields one or two places apart, (word, field) of those that occur)."""
    lex = lexicon(spark, sf)
    docs = token_docs(spark, sf)
    pairs = docs.select(F.explode(F.concat(neighbours(F.col("toks")), neighbours(F.col("toks"), 2))).alias("b")).select("b.*").where("w1 <> w2")
    pairs = pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(lex.select(F.col("word").alias("w1"), F.col("field").alias("f1")), "w1").join(lex.select(F.col("word").alias("w2"), F.col("field").alias("f2")), "w2")
    return pairs, lex.join(stats.word_counts(docs).select(F.col("tok").alias("word")), "word")


@query(f"""WITH {TOKENS}, {DICT}, {_LEX}, p AS (SELECT tok AS w1, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tokens),
t AS (SELECT a.field AS f1, b.field AS f2, count(*) AS n FROM p JOIN lex a ON a.word = w1 JOIN lex b ON b.word = w2 GROUP BY 1, 2)
SELECT f1 AS from_field, f2 AS to_field, round(n * 1.0 / sum(n) OVER (PARTITION BY f1), 6) AS p, n * 1.0 / sum(n) OVER (PARTITION BY f1) > 0.4 AS dominant FROM t""")
def cluster_transitions(spark, sf):
    """Odds of each field after each field, and which are over 0.4."""
    lex = lexicon(spark, sf)
    pairs = stats.word_pairs(token_docs(spark, sf))
    pairs = pairs.join(lex.select(F.col("word").alias("w1"), F.col("field").alias("f1")), "w1").join(lex.select(F.col("word").alias("w2"), F.col("field").alias("f2")), "w2")
    n = pairs.groupBy("f1", "f2").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("f1"))
    return n.select(F.col("f1").alias("from_field"), F.col("f2").alias("to_field"), r6(p).alias("p"), (p > 0.4).alias("dominant"))


_BEST = "best AS (SELECT skel, word FROM (SELECT skel, word, row_number() OVER (PARTITION BY skel ORDER BY freq DESC, word) AS r FROM idx) WHERE r = 1)"


@query(f"""{_BASE}, {_BEST}, n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1), dc AS (SELECT t.doc_id, t.pos, n.n, coalesce(b.word, '[' || t.tok || ']') AS w, b.word IS NOT NULL AS ok FROM tokens t JOIN n USING (doc_id) LEFT JOIN best b ON b.skel = {skeleton('t.tok')} WHERE n.n >= 4),
q AS (SELECT doc_id, pos, w, ok, CASE WHEN pos < n // 4 THEN 1 WHEN pos >= n - n // 4 THEN 4 END AS q FROM dc), p AS (SELECT q, w AS w1, lead(w) OVER (PARTITION BY doc_id, q ORDER BY pos) AS w2 FROM q WHERE q IS NOT NULL),
j AS (SELECT q, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT q, w1, w2, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
x AS (SELECT q, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT q, w1, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY 1, 2) GROUP BY 1), e AS (SELECT q, j.h - x.h AS h FROM j JOIN x USING (q)),
t AS (SELECT q, count(DISTINCT w) * 1.0 / count(*) AS ttr FROM q WHERE q IS NOT NULL GROUP BY 1), a AS (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS rate, avg(CASE WHEN pos = 0 THEN CASE WHEN ok THEN 1.0 ELSE 0.0 END END) AS heads FROM dc),
z AS (SELECT max(h) FILTER (q = 1) AS h1, max(h) FILTER (q = 4) AS h4 FROM e), y AS (SELECT max(ttr) FILTER (q = 1) AS t1, max(ttr) FILTER (q = 4) AS t4 FROM t)
SELECT round(h1, 6) AS first_h, round(h4, 6) AS last_h, round(t1, 6) AS first_ttr, round(t4, 6) AS last_ttr, h1 > h4 AS preserved, round(rate, 6) AS rate, round(heads, 6) AS heads,
CAST(h1 > h4 AS INT) + CAST(t1 > t4 AS INT) + CAST(rate > 0.3 AS INT) + CAST(heads > 0.5 AS INT) + CAST(heads >= rate AS INT) >= 3 AS passes FROM z, y, a""")
def decoded_gradient(spark, sf):
    """Whether decoded documents begin with more varied words than they end with: first against last quarter, and five checks of which three must hold.

    Each word is read as the most frequent dictionary word of its skeleton. The
    checks: word entropy and share of types fall, over 0.3 of all words and over
    half of the first words are read, and first words are read no less than others.
    """
    best = _index(spark, sf).where("rank = 1").select("skel", F.col("word").alias("read"))
    types = _types(spark, sf).select("tok", "skel").join(best, "skel", "left").select("tok", F.coalesce("read", F.concat(F.lit("["), "tok", F.lit("]"))).alias("w"), F.col("read").isNotNull().cast("int").alias("ok"))
    docs = token_docs(spark, sf).withColumn("n", F.size("toks")).where("n >= 4")
    q = F.floor(F.col("n") / 4).cast("int")
    ends = F.array(F.struct(F.lit(1).alias("q"), F.slice("toks", F.lit(1), q).alias("t")), F.struct(F.lit(4).alias("q"), F.slice("toks", F.col("n") - q + 1, q).alias("t")))
    part = docs.select(F.inline(ends))
    one, two = types.select(F.col("tok").alias("w1"), F.col("w").alias("a")), types.select(F.col("tok").alias("w2"), F.col("w").alias("b"))
    pairs = part.select("q", F.explode(neighbours(F.col("t"))).alias("p")).select("q", "p.*").groupBy("q", "w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(one, "w1").join(two, "w2").groupBy("q", F.col("a").alias("w1"), F.col("b").alias("w2")).agg(F.sum("n").alias("n"))
    h = stats.word_conditional_entropy(pairs, "q").select("q", "h")
    words = part.select("q", F.explode("t").alias("tok")).groupBy("q", "tok").agg(F.count(F.lit(1)).alias("n")).join(types, "tok").groupBy("q", "w").agg(F.sum("n").alias("n"))
    ttr = words.groupBy("q").agg((F.count(F.lit(1)) / F.sum("n")).alias("ttr"))
    at = lambda c, k: F.max(F.when(F.col("q") == k, F.col(c)))
    z = h.join(ttr, "q").agg(at("h", 1).alias("h1"), at("h", 4).alias("h4"), at("ttr", 1).alias("t1"), at("ttr", 4).alias("t4"))
    all_ = docs.select(F.posexplode("toks").alias("pos", "tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == 0).alias("heads")).join(types, "tok")
    a = all_.agg((F.sum(F.col("n") * F.col("ok")) / F.sum("n")).alias("rate"), (F.sum(F.col("heads") * F.col("ok")) / F.sum("heads")).alias("heads"))
    checks = [F.col("h1") > F.col("h4"), F.col("t1") > F.col("t4"), F.col("rate") > 0.3, F.col("heads") > 0.5, F.col("heads") >= F.col("rate")]
    passes = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int")) >= 3
    return z.join(F.broadcast(a)).select(r6("h1").alias("first_h"), r6("h4").alias("last_h"), r6("t1").alias("first_ttr"), r6("t4").alias("last_ttr"), checks[0].alias("preserved"), r6("rate").alias("rate"), r6("heads").alias("heads"), passes.alias("passes"))


#: Trials of the permutations of whole documents and of whole corpora.
TRIALS, SWAP_ROWS = 100, 4096
_NAMES = """nm AS (SELECT DISTINCT item_id, tok AS name FROM btok WHERE length(tok) >= 7), items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k FROM (SELECT DISTINCT item_id FROM nm)), ni AS (SELECT count(*) AS n FROM items),
slot AS (SELECT doc_id, item_id FROM documents CROSS JOIN ni JOIN items ON items.k = doc_id % ni.n WHERE text IS NOT NULL), hit AS (SELECT DISTINCT doc_id, item_id FROM tokens JOIN nm ON nm.name = tok)"""
_SWAP = f"""bk AS (SELECT greatest(1, count(*) // {SWAP_ROWS}) AS nb FROM slot), tr AS (SELECT unnest(range({TRIALS})) AS trial),
sb AS (SELECT doc_id, item_id, {draw_sql('nb', "'b'", 'doc_id')} AS b FROM slot, bk), f AS (SELECT trial, b, item_id, row_number() OVER (PARTITION BY trial, b ORDER BY doc_id) AS r FROM sb, tr),
t AS (SELECT trial, b, doc_id, row_number() OVER (PARTITION BY trial, b ORDER BY md5(concat_ws('|', 'p', trial, doc_id)), doc_id) AS r FROM sb, tr),
c AS (SELECT f.trial, count(h.doc_id) AS n FROM f JOIN t ON t.trial = f.trial AND t.b = f.b AND t.r = f.r LEFT JOIN hit h ON h.doc_id = t.doc_id AND h.item_id = f.item_id GROUP BY 1),
o AS (SELECT count(*) AS n FROM slot JOIN hit USING (doc_id, item_id))"""


def _names(spark, sf):
    """(item_id, name): names of each item of the reference, its words of seven letters or more."""
    return reference_docs(spark, sf).select("item_id", F.explode("toks").alias("name")).where("length(name) >= 7").distinct()


def _slots(spark, sf):
    """(doc_id, item_id): the item whose names a document should hold."""
    items = _names(spark, sf).select("item_id").distinct().withColumn("k", F.row_number().over(Window.orderBy("item_id")) - 1)
    n = items.agg(F.count(F.lit(1)).alias("n"))
    docs = token_docs(spark, sf).join(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("k"))
    return docs.join(items, "k").select("doc_id", "item_id")


def _name_hits(spark, sf):
    """(doc_id, item_id): which items' names each document holds; words are joined once a type."""
    words = token_docs(spark, sf).select("doc_id", F.explode(F.array_distinct("toks")).alias("name"))
    return words.join(_names(spark, sf), "name").select("doc_id", "item_id").distinct()


@query(f"""WITH {TOKENS}, {DICT}, {_NAMES}, {_SWAP}
SELECT o.n AS observed, round(avg(c.n), 6) AS null_mean, max(c.n) AS null_max, round(avg(CASE WHEN c.n >= o.n THEN 1.0 ELSE 0.0 END), 6) AS p FROM c, o GROUP BY o.n""")
def permuted_texts(spark, sf):
    """Documents that hold a name of their own item, against texts dealt anew among the documents a hundred times.

    What each text matches is found once; a trial only joins ids. Texts change
    places in buckets of about ``SWAP_ROWS`` documents, so no trial is one sort.
    """
    slots, hits = _slots(spark, sf), _name_hits(spark, sf)
    buckets = slots.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / SWAP_ROWS)).alias("nb"))
    b = slots.join(F.broadcast(buckets)).withColumn("b", draw(F.col("nb"), F.lit("b"), F.col("doc_id")))
    own = b.select("doc_id", "item_id", "b", F.row_number().over(Window.partitionBy("b").orderBy("doc_id")).alias("r"))
    trials = b.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(TRIALS - 1))))
    key = F.md5(F.concat_ws("|", F.lit("p"), F.col("trial").cast("string"), F.col("doc_id").cast("string")))
    dealt = trials.select("trial", "b", "doc_id", F.row_number().over(Window.partitionBy("trial", "b").orderBy(key, "doc_id")).alias("r"))
    moved = dealt.join(own.select("b", "r", "item_id"), ["b", "r"])
    found = moved.join(hits, ["doc_id", "item_id"], "left_semi").groupBy("trial").agg(F.count(F.lit(1)).alias("n"))
    each = spark.range(TRIALS).select(F.col("id").cast("int").alias("trial")).join(found, "trial", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    o = slots.join(hits, ["doc_id", "item_id"], "left_semi").agg(F.count(F.lit(1)).alias("observed"))
    x = each.join(F.broadcast(o))
    return x.groupBy("observed").agg(r6(F.avg("n")).alias("null_mean"), F.max("n").alias("null_max"), r6(F.avg(F.when(F.col("n") >= F.col("observed"), 1.0).otherwise(0.0))).alias("p"))


@query(f"""WITH {TOKENS}, {DICT}, {_NAMES}, st AS (SELECT DISTINCT s.doc_id FROM slot s JOIN nm USING (item_id) JOIN tokens t ON t.doc_id = s.doc_id AND length(t.tok) >= 5 AND left(t.tok, 5) = left(nm.name, 5)),
bg AS (SELECT DISTINCT s.doc_id FROM slot s JOIN (SELECT item_id, tok AS a, lead(tok) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM btok) p USING (item_id)
  JOIN (SELECT doc_id, tok AS a, lead(tok) OVER w AS n1, lead(tok, 2) OVER w AS n2 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) x ON x.doc_id = s.doc_id AND x.a = p.a AND (x.n1 = p.b OR x.n2 = p.b) WHERE length(p.a) >= 7 AND length(p.b) >= 4)
SELECT CASE WHEN h.doc_id IS NOT NULL THEN 'exact' WHEN bg.doc_id IS NOT NULL THEN 'bigram' WHEN st.doc_id IS NOT NULL THEN 'stem' ELSE 'none' END AS kind, count(*) AS docs
FROM slot s LEFT JOIN hit h USING (doc_id, item_id) LEFT JOIN bg ON bg.doc_id = s.doc_id LEFT JOIN st ON st.doc_id = s.doc_id GROUP BY 1""")
def name_match_kinds(spark, sf):
    """How documents hold the names of their item: a name itself, else two words of the item within two places, else a word of like beginning."""
    slots, names = _slots(spark, sf), _names(spark, sf)
    pairs = reference_docs(spark, sf).select("item_id", F.explode(neighbours(F.col("toks"))).alias("b")).select("item_id", "b.*").where("length(w1) >= 7 and length(w2) >= 4")
    row = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    two = lambda b: F.concat_ws(" ", b["w1"], b["w2"])
    stem = lambda w: F.left(w, F.lit(5))
    asked = names.select("item_id", F.inline(F.array(row("exact", F.col("name")), row("stem", stem(F.col("name"))))))
    asked = asked.unionByName(pairs.select("item_id", F.lit("bigram").alias("kind"), F.concat_ws(" ", "w1", "w2").alias("key"))).distinct()
    # only what some item asks for goes on to its documents, so words and pairs of the texts meet the items' first
    t = F.col("toks")
    near = F.filter(F.concat(neighbours(t), neighbours(t, 2)), lambda b: (F.length(b["w1"]) >= 7) & (F.length(b["w2"]) >= 4))
    held = F.concat(F.transform(F.array_distinct(t), lambda w: row("exact", w)), F.transform(F.array_distinct(F.transform(near, two)), lambda x: row("bigram", x)), F.transform(F.array_distinct(F.transform(F.filter(t, lambda w: F.length(w) >= 5), stem)), lambda x: row("stem", x)))
    own = token_docs(spark, sf).select("doc_id", F.inline(held))
    own = own.join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi").join(slots.distinct(), "doc_id")
    found = own.join(asked, ["item_id", "kind", "key"], "left_semi").groupBy("doc_id").agg(*(F.max(F.col("kind") == k).alias(k) for k in ("exact", "bigram", "stem")))
    x = slots.join(found, "doc_id", "left")
    kind = F.when(F.col("exact"), "exact").when(F.col("bigram"), "bigram").when(F.col("stem"), "stem").otherwise("none")
    return x.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"""WITH {DICT}, {_LEX}, c AS (SELECT DISTINCT item_id, tok AS candidate FROM btok WHERE length(tok) >= 5), n AS (SELECT item_id, count(*) AS candidates, count(l.word) FILTER (l.field <> 0) AS mapped,
coalesce(list(DISTINCT l.field ORDER BY l.field) FILTER (l.field <> 0), []) AS fields FROM c LEFT JOIN lex l ON l.word = c.candidate GROUP BY 1) SELECT item_id, candidates, mapped, array_to_string(fields, ',') AS fields, mapped > 0 AS testable FROM n""")
def multivalued_names(spark, sf):
    """Items with several candidate words joined to the lexicon: how many are in it, in which fields, and whether the item can be tested. Field 0 has no names."""
    c = reference_docs(spark, sf).select("item_id", F.explode(F.array_distinct("toks")).alias("word")).where("length(word) >= 5").distinct()
    x = c.join(lexicon(spark, sf).select("word", F.nullif("field", F.lit(0)).alias("field")), "word", "left")
    g = x.groupBy("item_id").agg(F.count(F.lit(1)).alias("candidates"), F.count("field").alias("mapped"), F.sort_array(F.collect_set("field")).alias("fields"))
    return g.select("item_id", "candidates", "mapped", F.array_join("fields", ",").alias("fields"), (F.col("mapped") > 0).alias("testable"))


_GRAD = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"


@query(f"""WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1), o AS (SELECT -1 AS trial, CASE WHEN pos < n // 4 THEN 1 ELSE 4 END AS q, tok FROM tokens JOIN n USING (doc_id) WHERE n >= 4 AND (pos < n // 4 OR pos >= n - n // 4)),
tr AS (SELECT unnest(range(10)) AS trial), z AS (SELECT trial, {draw_sql(4, "'g'", 'trial', 'doc_id', 'pos')} AS q, tok FROM tokens, tr), u AS (SELECT trial, q, tok, count(*) AS c FROM (SELECT * FROM o UNION ALL SELECT trial, q + 1, tok FROM z WHERE q IN (0, 3)) GROUP BY 1, 2, 3),
g AS (SELECT trial, q, substr(tok, CAST(k AS BIGINT), 1) AS a, substr(tok, CAST(k + 1 AS BIGINT), 1) AS b, c FROM (SELECT *, unnest(range(1, length(tok))) AS k FROM u)),
j AS (SELECT trial, q, {_GRAD} AS h FROM (SELECT trial, q, a, b, sum(c) AS n FROM g GROUP BY 1, 2, 3, 4) GROUP BY 1, 2), x AS (SELECT trial, q, {_GRAD} AS h FROM (SELECT trial, q, a, sum(c) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2),
d2 AS (SELECT trial, max(j.h - x.h) FILTER (q = 4) - max(j.h - x.h) FILTER (q = 1) AS v FROM j JOIN x USING (trial, q) GROUP BY 1), r AS (SELECT v FROM d2 WHERE trial = -1)
SELECT round(r.v, 6) AS observed, round(avg(d2.v), 6) AS null_mean, round(stddev_pop(d2.v), 6) AS null_sd, round(avg(CASE WHEN (r.v > 0 AND d2.v >= r.v) OR (r.v <= 0 AND d2.v <= r.v) THEN 1.0 ELSE 0.0 END), 6) AS p
FROM d2, r WHERE d2.trial >= 0 GROUP BY r.v""")
def gradient_permutation(spark, sf):
    """The change of letter entropy from the first to the last quarter of documents, against places drawn anew over the whole corpus.

    A random order of all words puts a random quarter first and another last, so
    a trial draws a quarter for each place by its hash; letters are paired
    within words, so a trial is counts of types.
    """
    docs = token_docs(spark, sf).withColumn("n", F.size("toks"))
    q = F.floor(F.col("n") / 4)
    x = docs.select("doc_id", "n", q.alias("k"), F.posexplode("toks").alias("pos", "tok")).where("length(tok) > 1")
    # a draw of one in four is the last of the fifteen hex digits that are read, modulo 4; all trials are counted at once, a row a type
    trials = range(10)
    digit = lambda t: F.substring(F.md5(F.concat_ws("|", F.lit("g"), F.lit(str(t)), F.col("doc_id").cast("string"), F.col("pos").cast("string"))), 15, 1)
    side = F.when(F.col("n") < 4, None).when(F.col("pos") < F.col("k"), 1).when(F.col("pos") >= F.col("n") - F.col("k"), 4)
    rows = x.select("tok", side.alias("side"), *(digit(t).alias(f"d{t}") for t in trials))
    sides = {(-1, 1): F.col("side") == 1, (-1, 4): F.col("side") == 4}
    sides |= {(t, n): F.col(f"d{t}").isin(*digits) for t in trials for n, digits in ((1, "048c"), (4, "37bf"))}
    names = {at: f"c{i}" for i, at in enumerate(sides)}
    u = rows.groupBy("tok").agg(*(F.count_if(sides[at]).alias(name) for at, name in names.items()))
    pairs = F.transform(F.sequence(F.lit(1), F.length("tok") - 1), lambda i: F.struct(F.substring("tok", i, F.lit(1)).alias("w1"), F.substring("tok", i + 1, F.lit(1)).alias("w2")))
    n = u.select(*names.values(), F.explode(pairs).alias("p")).groupBy("p.w1", "p.w2").agg(*(F.sum(name).alias(name) for name in names.values()))
    cells = F.array(*(F.struct(F.lit(t).alias("trial"), F.lit(k).alias("q"), F.col(name).alias("n")) for (t, k), name in names.items()))
    g = n.select("w1", "w2", F.inline(cells)).where("n > 0")
    h = stats.word_conditional_entropy(g, "trial", "q")
    v = h.groupBy("trial").agg((F.max(F.when(F.col("q") == 4, F.col("h"))) - F.max(F.when(F.col("q") == 1, F.col("h")))).alias("v"))
    both = v.where("trial >= 0").join(F.broadcast(v.where("trial = -1").select(F.col("v").alias("o"))))
    beyond = ((F.col("o") > 0) & (F.col("v") >= F.col("o"))) | ((F.col("o") <= 0) & (F.col("v") <= F.col("o")))
    return both.groupBy(F.col("o").alias("raw")).agg(r6(F.avg("v")).alias("null_mean"), r6(F.stddev_pop("v")).alias("null_sd"), r6(F.avg(F.when(beyond, 1.0).otherwise(0.0))).alias("p")).select(r6("raw").alias("observed"), "null_mean", "null_sd", "p")


#: Stages of resolution, in order.
STAGES = ("identity", "skeleton", "stripped", "fuzzy")
_STRIP = "(ing|ed|er|ly|es|s)$"


def _ablation_sql():
    flags = {s: f"f{i}" for i, s in enumerate(STAGES)}
    alls = " OR ".join(flags.values())
    parts = [("baseline", alls)]
    parts += [(f"without_{s}", " OR ".join(f for t, f in flags.items() if t != s)) for s in STAGES]
    parts += [(f"upto_{s}", " OR ".join(list(flags.values())[: i + 1])) for i, s in enumerate(STAGES)]
    return " UNION ALL ".join(f"SELECT '{name}' AS setting, round(sum(CASE WHEN {e} THEN c ELSE 0 END) * 1.0 / sum(c), 6) AS rate FROM fl" for name, e in parts)


@query(f"""{_BASE}, {_FUZZY}, sk0 AS (SELECT DISTINCT skel FROM idx), fl AS (SELECT c, tok IN (SELECT word FROM dict) AS f0, skel IN (SELECT skel FROM sk0) AS f1,
regexp_replace(tok, '{_STRIP}', '') <> tok AND {skeleton(f"regexp_replace(tok, '{_STRIP}', '')")} IN (SELECT skel FROM sk0) AS f2, skel IN (SELECT skel FROM near) AS f3 FROM types) {_ablation_sql()}""")
def ablation_cascade(spark, sf):
    """Share of words resolved with each stage left out, and with stages added one by one; every stage is tried once a type."""
    t, i = _types(spark, sf), _index(spark, sf)
    known = dictionary(spark, sf).select(F.col("word").alias("tok"), F.lit(True).alias("f0"))
    keys = i.select("skel").distinct()
    less = F.regexp_replace("tok", _STRIP, "")
    x = t.withColumn("low", F.when(less != F.col("tok"), ft.skeleton(less)))
    x = x.join(known, "tok", "left").join(keys.withColumn("f1", F.lit(True)), "skel", "left").join(keys.select(F.col("skel").alias("low"), F.lit(True).alias("f2")), "low", "left")
    x = x.join(m.fuzzy_matches(t.select("tok", "skel"), i).select("tok").distinct().withColumn("f3", F.lit(True)), "tok", "left")
    flag = [F.coalesce(f"f{k}", F.lit(False)) for k in range(4)]
    either = lambda some: F.greatest(*(c.cast("int") for c in some), F.lit(0))
    settings = {"baseline": flag}
    settings |= {f"without_{s}": [c for j, c in enumerate(flag) if j != k] for k, s in enumerate(STAGES)}
    settings |= {f"upto_{s}": flag[: k + 1] for k, s in enumerate(STAGES)}
    sums = x.agg(F.sum("c").alias("total"), *(F.sum(either(v) * F.col("c")).alias(k) for k, v in settings.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("setting"), r6(F.col(k) / F.col("total")).alias("rate")) for k in settings))))


_T = "types AS (SELECT tok, count(*) AS c FROM tokens GROUP BY 1)"
#: Consonants that may begin a syllable together, and vowels that sound as one.
ONSETS = ["bl", "br", "cl", "cr", "dr", "fl", "fr", "gl", "gr", "pl", "pr", "tr", "sc", "sp", "st", "str", "spr", "qu", "gn", "mn", "pn", "ps", "pt"]
DIPHTHONGS = ["ae", "oe", "au"]
_NUCLEUS = f"({'|'.join(DIPHTHONGS)}|qu|[aeiou])"
_ONSET = "(" + "|".join(sorted((x for x in ONSETS if x != "qu"), key=lambda x: (-len(x), x))) + "|[^aeiou#])$"


@query(f"""WITH {TOKENS}, {_T}, s AS (SELECT tok, c, regexp_replace(tok, '{_NUCLEUS}', '#\\1#', 'g') AS m FROM types), p AS (SELECT tok, c, string_split(m, '#') AS p FROM s),
w AS (SELECT tok, c, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN x WHEN i = 1 OR i = len(p) THEN x WHEN x = '' THEN '-' ELSE regexp_replace(x, '{_ONSET}', '-\\1') END), '') AS syl FROM p)
SELECT tok, syl, CAST(len(string_split(syl, '-')) AS BIGINT) AS n FROM w""")
def syllabify_onsets(spark, sf):
    """Words cut before the longest group of consonants that may begin a syllable; q with its u counts as a vowel's sign."""
    t = stats.word_counts(token_docs(spark, sf)).select("tok")
    p = F.split(F.regexp_replace("tok", _NUCLEUS, "#$1#"), "#")
    t = t.select("tok", p.alias("p"))
    n = F.size("p")
    cut = F.transform("p", lambda x, i: F.when((i % 2 == 1) | (i == 0) | (i == n - 1), x).when(x == "", "-").otherwise(F.regexp_replace(x, _ONSET, "-$1")))
    t = t.select("tok", F.array_join(cut, "").alias("syl"))
    return t.select("tok", "syl", F.size(F.split("syl", "-")).cast("long").alias("n"))


_GC = """ps AS MATERIALIZED (SELECT ch, sum(CASE WHEN i = 1 AND len > 1 THEN c ELSE 0 END) AS ini, sum(CASE WHEN i = len AND len > 1 THEN c ELSE 0 END) AS fin, sum(c) AS n FROM (SELECT substr(tok, CAST(i AS BIGINT), 1) AS ch, i, length(tok) AS len, c FROM (SELECT tok, c, unnest(range(1, length(tok) + 1)) AS i FROM types)) GROUP BY 1),
gc AS MATERIALIZED (SELECT coalesce(string_agg(ch, '' ORDER BY ch) FILTER (ini * 1.0 / n >= 0.25), '0') AS p, coalesce(string_agg(ch, '' ORDER BY ch) FILTER (fin * 1.0 / n >= 0.25), '0') AS s FROM ps)"""


@query(f"""WITH {TOKENS}, {_T}, {_GC}, x AS (SELECT tok, left(tok, length(tok) - length(ltrim(tok, p))) AS pre, right(tok, length(tok) - length(rtrim(tok, s))) AS suf FROM types, gc)
SELECT tok, pre AS prefix, suf AS suffix, substr(tok, length(pre) + 1, greatest(length(tok) - length(pre) - length(suf), 0)) AS root FROM x""")
def positional_parts(spark, sf):
    """Words as the letters at the front that mostly begin words, the letters at the end that mostly end them, and the rest between.

    Letters with a quarter of their uses at that place count. The classes are
    two strings of 26 letters at most.
    """
    c = stats.word_counts(token_docs(spark, sf))
    where = stats.positions(c)
    n = sum((F.col(k) for k in ("medial", "final", "singleton")), F.col("initial"))
    pick = lambda k: F.array_join(F.sort_array(F.collect_list(F.when(F.col(k) / n >= 0.25, F.col("ch")))), "")
    classes = where.agg(pick("initial").alias("p"), pick("final").alias("s"))
    size = lambda cls, rev: F.length("tok") - F.length(F.ltrim(F.reverse("tok") if rev else F.col("tok"), F.col(cls)))
    x = c.select("tok").join(F.broadcast(classes)).withColumn("a", size("p", False)).withColumn("b", size("s", True))
    root = F.substring("tok", F.col("a") + 1, F.greatest(F.length("tok") - F.col("a") - F.col("b"), F.lit(0)))
    return x.select("tok", F.left("tok", F.col("a")).alias("prefix"), F.right("tok", F.col("b")).alias("suffix"), root.alias("root"))


def _fits(tags: dict[str, list[str]]):
    return {k: f"({'|'.join(v)})$" for k, v in tags.items()}


_ENDINGS = _fits({"VERB": ft.VERB_ENDINGS, "ADJ": ft.ADJECTIVE_ENDINGS, "NOUN": ft.ADJECTIVE_ENDINGS})


@query(f"""WITH {TOKENS}, {DICT}, {_T}, g AS (SELECT tok, {pos_tag('tok')} AS tag FROM types), i AS (SELECT word, {skeleton('word')} AS skel FROM dict), t AS (SELECT tok, tag, {skeleton('tok')} AS skel FROM g WHERE tag IN ('VERB', 'ADJ', 'NOUN'))
SELECT tag, count(*) AS candidates, count(*) FILTER (regexp_matches(word, CASE tag {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ENDINGS.items())} END)) AS compatible FROM t JOIN i ON i.skel = t.skel WHERE t.skel <> '' GROUP BY 1""")
def pos_compatible(spark, sf):
    """Candidates of tagged words whose ending fits the tag; endings are tested once a dictionary word."""
    t = _types(spark, sf).select("skel", ft.pos_tag(F.col("tok")).alias("tag")).where(F.col("tag").isin(*_ENDINGS)).groupBy("skel", "tag").agg(F.count(F.lit(1)).alias("n"))
    fits = [F.count_if(F.col("word").rlike(rx)).alias(k) for k, rx in _ENDINGS.items()]
    i = _index(spark, sf).groupBy("skel").agg(F.count(F.lit(1)).alias("w"), *fits)
    own = F.coalesce(*(F.when(F.col("tag") == k, F.col(k)) for k in _ENDINGS))
    return t.join(i, "skel").groupBy("tag").agg(F.sum(F.col("n") * F.col("w")).alias("candidates"), F.sum(F.col("n") * own).alias("compatible"))


@query(f"""WITH {TOKENS}, s AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM d), y AS (SELECT doc_id, pos, unnest(regexp_extract_all(tok, '[^aeiouy]*[aeiouy]|[^aeiouy]+$')) AS syl, unnest(range(len(regexp_extract_all(tok, '[^aeiouy]*[aeiouy]|[^aeiouy]+$')))) AS k FROM s),
c AS (SELECT doc_id, pos, k, translate(substr(md5(syl || '|' || {draw_sql(3, "'h'", 'doc_id', 'pos', 'k')}), 1, 4), '0123456789', 'ghijklmnop') AS w FROM y)
SELECT doc_id, count(*) AS words, md5(string_agg(w, ' ' ORDER BY pos, k)) AS cipher_md5 FROM c GROUP BY 1""")
def syllabary_code(spark, sf):
    """Each syllable becomes one of three code words of its own, chosen by its place; all within the row."""
    docs = token_docs(spark, sf).where(F.size("toks") > 0)
    syl = lambda t: F.regexp_extract_all(t, F.lit("([^aeiouy]*[aeiouy]|[^aeiouy]+$)"), F.lit(1))

    def code(s, pos, k, doc):
        return F.translate(F.left(F.md5(F.concat(s, F.lit("|"), draw(3, F.lit("h"), doc, pos, k).cast("string"))), F.lit(4)), "0123456789", "ghijklmnop")

    words = F.flatten(F.transform("toks", lambda t, i: F.transform(syl(t), lambda s, k: code(s, i, k, F.col("doc_id")))))
    return docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("cipher_md5"))


@query()
def label_clusters(spark, sf):
    """Greedy clusters of short lines by their letters: a line joins the first earlier one that opened a cluster and shares over half of both letter sets.

    Lines of one letter set go together, so only distinct letter sets, as masks
    of 26 bits, are put in order by their first line; their number does not
    follow the corpus.
    """
    ship_package(spark)
    lines = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("label", F.trim(F.lower("line")))
    labels = lines.where("length(label) between 1 and 40").select("doc_id", "label")
    chars = F.array_distinct(F.filter(F.split(F.regexp_replace("label", "[^a-z]", ""), ""), lambda c: c != ""))
    mask = F.aggregate(chars, F.lit(0), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(c) - 97)))
    rows = labels.withColumn("mask", mask).where("mask <> 0")
    first = rows.groupBy("mask").agg(F.min("label").alias("first"))
    seeds = search.greedy_sets(first)
    x = rows.join(seeds, "mask")
    g = x.groupBy("seed").agg(F.count_distinct("label").alias("size"), F.approx_count_distinct("doc_id", 0.01).alias("docs_about"), F.min("label").alias("first_label"))
    return g.where("size > 1").select("first_label", "size", "docs_about")


def _h_sql(expr):
    """Entropies of letters of orders one to three by language, over words rewritten by ``expr``, letters within words."""
    g = f"SELECT lang, c, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT lang, c, {expr} AS w FROM lt) WHERE w <> ''"
    k = f"SELECT lang, c, substr(w, i, 1) AS a, CASE WHEN i < length(w) THEN substr(w, i, 2) END AS b, CASE WHEN i < length(w) - 1 THEN substr(w, i, 3) END AS t FROM ({g})"
    ent = lambda col, need: f"(SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, {col} AS g, sum(c) AS n FROM ({k}) WHERE {need} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
    parts = {"a": ent("a", "a"), "b": ent("b", "b"), "ba": ent("a", "b"), "t": ent("t", "t"), "tb": ent("left(t, 2)", "t")}
    return "SELECT a.lang, a.h AS h1, b.h - ba.h AS h2, t.h - tb.h AS h3 FROM " + " JOIN ".join(f"{q} {n}" + ("" if n == "a" else " USING (lang)") for n, q in parts.items())


def _h_change_sql(expr):
    return f"WITH {TOKENS}, lt AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2), x AS ({_h_sql('tok')}), y AS ({_h_sql(expr)}) SELECT x.lang, " + ", ".join(f"round(x.h{i}, 6) AS h{i}, round(y.h{i} - x.h{i}, 6) AS change{i}" for i in (1, 2, 3)) + " FROM x JOIN y USING (lang)"


def _h_change(spark, sf, f):
    t = stats.word_counts(token_docs(spark, sf), "lang")

    def h(word, mark):
        w = t.select("lang", "c", word.alias("w")).where("w <> ''")
        at = lambda i, n: F.when(i + n - 1 <= F.length("w"), F.substring("w", i, F.lit(n)))
        g = w.select("lang", "c", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.struct(at(i, 1).alias("a"), at(i, 2).alias("b"), at(i, 3).alias("t")))).alias("g"))
        n = g.groupBy("lang", "g.a", "g.b", "g.t").agg(F.sum("c").alias("n"))
        joint = lambda key, need, name: n.where(F.col(need).isNotNull()).groupBy("lang", key.alias("k")).agg(F.sum("n").alias("n")).groupBy("lang").agg(stats.bits("n").alias(name))
        out = joint(F.col("a"), "a", "ha")
        for part in ((F.col("b"), "b", "hb"), (F.col("a"), "b", "hba"), (F.col("t"), "t", "ht"), (F.left("t", F.lit(2)), "t", "htb")):
            out = out.join(joint(*part), "lang")
        return out.select("lang", F.col("ha").alias(f"{mark}1"), (F.col("hb") - F.col("hba")).alias(f"{mark}2"), (F.col("ht") - F.col("htb")).alias(f"{mark}3"))

    x = h(F.col("tok"), "x").join(h(f(F.col("tok")), "y"), "lang")
    return x.select("lang", *(c for i in (1, 2, 3) for c in (r6(F.col(f"x{i}")).alias(f"h{i}"), r6(F.col(f"y{i}") - F.col(f"x{i}")).alias(f"change{i}"))))


_CORE = "^(un|re|in|con|de|pre)|(ing|ed|er|ly|es|en)$"


@query(_h_change_sql(f"regexp_replace(tok, '{_CORE}', '', 'g')"))
def core_isolation_orders(spark, sf):
    """Entropies of letters of three orders once customary beginnings and ends are stripped."""
    return _h_change(spark, sf, lambda t: F.regexp_replace(t, _CORE, ""))


@query(_h_change_sql("replace(tok, 'qu', 'q')"))
def substitution_effect_orders(spark, sf):
    """Entropies of letters of three orders once a pair of letters is read as one."""
    return _h_change(spark, sf, lambda t: F.replace(t, F.lit("qu"), F.lit("q")))


_CURVES = """s AS (SELECT source, tok, count(*) AS c FROM tokens GROUP BY 1, 2), p AS (SELECT source, i, substr(tok, CAST(i + 1 AS BIGINT), 1) AS ch, sum(c) AS n FROM s, range(10) r(i) WHERE i < length(tok) GROUP BY 1, 2, 3),
h AS (SELECT source, i, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM p GROUP BY 1, 2), a AS (SELECT i, avg(h) AS m, stddev_pop(h) AS sd FROM h GROUP BY 1)"""


@query(f"""WITH {TOKENS}, {_CURVES}, z AS (SELECT h.source, h.h, a.m, CASE WHEN a.sd > 1e-9 THEN (h.h - a.m) / a.sd ELSE 0 END AS z FROM h JOIN a USING (i)),
r AS (SELECT source, sum(h * m) / sqrt(sum(h * h) * sum(m * m)) AS cosine, avg(abs(z)) AS mean_z, avg(CASE WHEN abs(z) > 2.576 THEN 1.0 ELSE 0.0 END) AS beyond FROM z GROUP BY 1)
SELECT source, round(cosine, 6) AS cosine, round(mean_z, 6) AS mean_z, beyond > 0.5 AS excluded, row_number() OVER (ORDER BY round(cosine, 9) DESC, source) AS rank FROM r""")
def curve_ranks(spark, sf):
    """Sources by how like their curve is to the mean one; excluded where over half of the places lie beyond 2.576 deviations."""
    s = stats.word_counts(token_docs(spark, sf), "source")
    p = s.select("source", "c", F.posexplode(F.slice(F.filter(F.split("tok", ""), lambda x: x != ""), 1, 10)).alias("i", "ch"))
    h = p.groupBy("source", "i", "ch").agg(F.sum("c").alias("n")).groupBy("source", "i").agg(stats.bits("n").alias("h"))
    a = h.groupBy("i").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("sd"))
    z = h.join(F.broadcast(a), "i").withColumn("z", F.when(F.col("sd") > 1e-9, (F.col("h") - F.col("m")) / F.col("sd")).otherwise(0.0))
    hh, mm, hm = (F.sum(F.col(x) * F.col(y)) for x, y in (("h", "h"), ("m", "m"), ("h", "m")))
    r = z.groupBy("source").agg((hm / F.sqrt(hh * mm)).alias("cosine"), F.avg(F.abs("z")).alias("mean_z"), F.avg(F.when(F.abs("z") > 2.576, 1.0).otherwise(0.0)).alias("beyond"))
    # one row a source
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("cosine", 9)), "source"))
    return r.select("source", r6("cosine").alias("cosine"), r6("mean_z").alias("mean_z"), (F.col("beyond") > 0.5).alias("excluded"), rank.alias("rank"))


_SUR = """lw AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2), sp AS (SELECT lang, tok, log2(sum(c) OVER (PARTITION BY lang) * 1.0 / c) AS v FROM lw),
th AS (SELECT lang, quantile_disc(v, 0.95) AS cut FROM (SELECT t.lang, sp.v FROM tokens t JOIN sp ON sp.lang = t.lang AND sp.tok = t.tok) GROUP BY 1)"""


@query(f"""WITH {TOKENS}, {_SUR}, r AS (SELECT t.doc_id, t.lang, count(*) AS n, count(*) FILTER (sp.v > th.cut) AS odd FROM tokens t JOIN sp ON sp.lang = t.lang AND sp.tok = t.tok JOIN th ON th.lang = t.lang GROUP BY 1, 2)
SELECT lang, doc_id, n, odd, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(odd * 1.0 / n, 9), doc_id) AS rank FROM r WHERE n >= 20) WHERE rank <= 10""")
def reliable_documents(spark, sf):
    """The ten documents of each language with the smallest share of anomalous words: those beyond the 95th percentile of surprisal.

    Words of one count have one surprisal, so the percentile comes from counts
    of counts.
    """
    docs = token_docs(spark, sf)
    c = stats.word_counts(docs, "lang")
    by = c.groupBy("lang", "c").agg(F.sum("c").alias("k"))
    w = Window.partitionBy("lang")
    upto = F.sum("k").over(w.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    # the least frequent count whose words, with all more frequent ones, reach the share
    cut = by.withColumn("upto", upto).withColumn("total", F.sum("k").over(w)).where(F.col("upto") >= F.ceil(F.col("total") * 0.95)).groupBy("lang").agg(F.max("c").alias("cut"))
    odd = c.join(F.broadcast(cut), "lang").where("c < cut").select("lang", "tok", F.lit(1).alias("odd"))
    per = stats.word_counts(docs, "doc_id", "lang").join(odd, ["lang", "tok"], "left")
    r = per.groupBy("doc_id", "lang").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("odd") == 1, F.col("c")).otherwise(0)).alias("odd")).where("n >= 20")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.round(F.col("odd") / F.col("n"), 9), "doc_id"))
    return r.withColumn("rank", rank).where("rank <= 10").select("lang", "doc_id", "n", "odd", "rank")


@query(f"""WITH {TOKENS}, {DICT}, {_LEX}, v AS (SELECT lang, tok, count(*) AS c FROM tokens WHERE lang IN ('en', 'fr') GROUP BY 1, 2), k AS (SELECT count(*) AS shared FROM (SELECT tok FROM v GROUP BY 1 HAVING count(*) = 2)),
n AS (SELECT count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'fr') AS b FROM v), f AS (SELECT lang, field, sum(c) AS c FROM v JOIN lex ON lex.word = v.tok GROUP BY 1, 2), t AS (SELECT lang, sum(c) AS t FROM v GROUP BY 1)
SELECT f.field, round(max(f.c * 1.0 / t.t) FILTER (f.lang = 'en'), 6) AS share_a, round(max(f.c * 1.0 / t.t) FILTER (f.lang = 'fr'), 6) AS share_b, max(n.a) AS types_a, max(n.b) AS types_b, max(k.shared) AS shared FROM f JOIN t USING (lang), n, k GROUP BY 1""")
def field_shares(spark, sf):
    """Shares of each field in two languages, beside the sizes of their vocabularies and what both have."""
    v = stats.word_counts(token_docs(spark, sf).where(F.col("lang").isin("en", "fr")), "lang")
    each = v.groupBy("tok").pivot("lang", ["en", "fr"]).agg(F.first("c"))
    sizes = each.agg(F.count("en").alias("types_a"), F.count("fr").alias("types_b"), F.count_if(F.col("en").isNotNull() & F.col("fr").isNotNull()).alias("shared"), F.sum("en").alias("ta"), F.sum("fr").alias("tb"))
    f = each.join(lexicon(spark, sf).withColumnRenamed("word", "tok"), "tok").groupBy("field").agg(F.sum("en").alias("a"), F.sum("fr").alias("b"))
    return f.join(F.broadcast(sizes)).select("field", r6(F.col("a") / F.col("ta")).alias("share_a"), r6(F.col("b") / F.col("tb")).alias("share_b"), "types_a", "types_b", "shared")


@query(f"""{_BASE}, e AS (SELECT DISTINCT skel FROM idx), fk AS (SELECT c, {skeleton("translate(tok, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm')")} AS skel, length(tok) AS len, left(translate(tok, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm'), 1) AS f FROM types),
rl AS (SELECT c, skel, length(tok) AS len, left(tok, 1) AS f FROM types WHERE skel <> ''), ck AS (SELECT DISTINCT skel, length(word) AS len, left(word, 1) AS f FROM idx),
x AS ({" UNION ALL ".join(f"SELECT '{k}' AS condition, '{src}' AS side, sum(CASE WHEN EXISTS (SELECT 1 FROM ck WHERE {cond}) THEN s.c ELSE 0 END) * 1.0 / (SELECT sum(c) FROM types) AS rate FROM {src} s" for k, cond in (("skeleton", "ck.skel = s.skel"), ("length", "ck.skel = s.skel AND ck.len = s.len"), ("first", "ck.skel = s.skel AND ck.f = s.f"), ("both", "ck.skel = s.skel AND ck.len = s.len AND ck.f = s.f")) for src in ("rl", "fk"))})
SELECT condition, round(max(rate) FILTER (side = 'rl'), 6) AS real_rate, round(max(rate) FILTER (side = 'fk'), 6) AS null_rate, round(max(rate) FILTER (side = 'rl') / nullif(max(rate) FILTER (side = 'fk'), 0), 6) AS selectivity FROM x GROUP BY 1""")
def selectivity_conditions(spark, sf):
    """Rates of matched words against words of a shifted alphabet under four conditions: skeleton, and length, first letter or both besides."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    t = stats.word_counts(token_docs(spark, sf))
    fake = F.translate("tok", abc, abc[13:] + abc[:13])
    sides = t.select("c", F.lit("real").alias("side"), F.col("tok").alias("w")).unionByName(t.select("c", F.lit("null").alias("side"), fake.alias("w")))
    s = sides.select("c", "side", ft.skeleton(F.col("w")).alias("skel"), F.length("w").alias("len"), F.left("w", F.lit(1)).alias("f"))
    ck = _index(spark, sf).select("skel", F.length("word").alias("len"), F.left("word", F.lit(1)).alias("f")).distinct()
    for name, key in (("skeleton", ["skel"]), ("length", ["skel", "len"]), ("first", ["skel", "f"]), ("both", ["skel", "len", "f"])):
        s = s.join(ck.select(*key).distinct().withColumn(name, F.lit(1)), key, "left")
    names = ("skeleton", "length", "first", "both")
    sums = s.groupBy("side").agg(F.sum("c").alias("n"), *(F.sum(F.coalesce(F.col(n), F.lit(0)) * F.col("c")).alias(n) for n in names))
    long = sums.select("side", F.inline(F.array(*(F.struct(F.lit(n).alias("condition"), (F.col(n) / F.col("n")).alias("rate")) for n in names))))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("rate")))
    return long.groupBy("condition").agg(r6(side("real")).alias("real_rate"), r6(side("null")).alias("null_rate"), r6(F.try_divide(side("real"), side("null"))).alias("selectivity"))
