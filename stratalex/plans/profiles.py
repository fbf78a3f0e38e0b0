"""Queries that hold profiles, labels and parameters against a reference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as ft
from stratalex.operators import search, stats
from stratalex.plans.matching import _index
from stratalex.plans.models import _RUNS, _hits, _runs
from stratalex.plans.registry import query
from stratalex.plans.sequences import DICTIONARY_WORDS
from stratalex.plans.sqltext import DICT, TOKENS, skeleton
from stratalex.session import Tables, materialize, ship_package
from stratalex.sources.tables import dictionary, reference_bigrams, reference_docs, table, token_array, token_docs

r6 = lambda c: F.round(c, 6)


@query(_RUNS + """, m AS (SELECT avg(rate) AS mean FROM x) SELECT round(whole.rate, 6) AS real, round(m.mean, 6) AS null_mean, round(avg(CASE WHEN abs(x.rate - m.mean) >= abs(whole.rate - m.mean) THEN 1.0 ELSE 0.0 END), 6) AS p,
round(avg(CASE WHEN x.rate < whole.rate THEN 1.0 ELSE 0.0 END), 6) AS percentile FROM x, whole, m GROUP BY whole.rate, m.mean""")
def two_tailed_p(spark, sf):
    """Where the whole corpus lies among its runs: the share of runs as far from their mean or farther, on either side."""
    x = _runs(spark, sf)
    whole = _hits(spark, sf).agg((F.sum("h") / F.sum("n")).alias("whole"))
    y = x.join(F.broadcast(x.agg(F.avg("rate").alias("mean")))).join(F.broadcast(whole))
    far = F.abs(F.col("rate") - F.col("mean")) >= F.abs(F.col("whole") - F.col("mean"))
    g = y.groupBy("whole", "mean").agg(r6(F.avg(F.when(far, 1.0).otherwise(0.0))).alias("p"), r6(F.avg(F.when(F.col("rate") < F.col("whole"), 1.0).otherwise(0.0))).alias("percentile"))
    return g.select(r6("whole").alias("real"), r6("mean").alias("null_mean"), "p", "percentile")


_TOLERANCE = {"h_word": 1.5, "exponent": 0.3, "ttr": 0.1}
_PROF = """un AS (SELECT 'reference' AS g, item_id AS id, toks FROM b UNION ALL SELECT lang, doc_id, toks FROM d), ut AS (SELECT g, id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM un),
uc AS (SELECT g, tok, count(*) AS c FROM ut GROUP BY 1, 2), ur AS (SELECT g, tok, c, row_number() OVER (PARTITION BY g ORDER BY c DESC, tok) AS rank, sum(c) OVER (PARTITION BY g) AS t FROM uc),
uz AS (SELECT g, -regr_slope(ln(c + 1e-10), ln(rank)) AS exponent, count(*) * 1.0 / sum(c) AS ttr FROM ur GROUP BY 1),
cum AS (SELECT g, c, sum(c) OVER (PARTITION BY g ORDER BY c DESC, tok) AS upto, t FROM ur), ub AS (SELECT g, count(*) FILTER (upto - c < 0.9 * t) AS codebook FROM cum GROUP BY 1),
up AS (SELECT g, tok AS w1, lead(tok) OVER (PARTITION BY g, id ORDER BY pos) AS w2 FROM ut), un2 AS (SELECT g, w1, w2, count(*) AS n FROM up WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
uh AS (SELECT a.g, a.h - x.h AS h_word FROM (SELECT g, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM un2 GROUP BY 1) a JOIN (SELECT g, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT g, w1, sum(n) AS n FROM un2 GROUP BY 1, 2) GROUP BY 1) x USING (g)),
pf AS (SELECT g, h_word, exponent, ttr, codebook FROM uz JOIN uh USING (g) JOIN ub USING (g))"""


def _profiles(spark, sf):
    """(g, h_word, exponent, ttr, codebook) of each language and of the reference."""
    docs = reference_docs(spark, sf).select(F.lit("reference").alias("g"), "toks").unionByName(token_docs(spark, sf).select(F.col("lang").alias("g"), "toks"))
    # one count of pairs, none after the last word of a text, gives words and pairs
    tables = Tables(spark)
    i = F.sequence(F.lit(0), F.size("toks") - 1)
    pairs = docs.where(F.size("toks") > 0).select("g", F.explode(F.transform(i, lambda k: F.struct(F.get("toks", k).alias("w1"), F.get("toks", k + 1).alias("w2")))).alias("b"))
    pairs = tables.put(pairs.groupBy("g", "b.w1", "b.w2").agg(F.count(F.lit(1)).alias("n")), "pairs")
    c = tables.put(pairs.groupBy("g", F.col("w1").alias("tok")).agg(F.sum("n").alias("c")), "words")
    z = stats.zipf(c, "g").select("g", "exponent", "ttr", "total")
    # words by count: those that make up nine tenths of the text, ties being equal
    by = c.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("g").orderBy(F.desc("c"))
    by = by.withColumn("before", F.sum(F.col("k") * F.col("c")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("k") * F.col("c")).join(z.select("g", "total"), "g")
    need = F.ceil((0.9 * F.col("total") - F.col("before")) / F.col("c")).cast("long")
    book = by.groupBy("g").agg(F.sum(F.greatest(F.lit(0), F.least(F.col("k"), need))).alias("codebook"))
    h = stats.word_conditional_entropy(pairs.where("w2 is not null"), "g").select("g", F.col("h").alias("h_word"))
    found, _ = materialize(z.drop("total").join(h, "g").join(book, "g"), "profiles")
    tables.drop()
    return found


@query(f"""WITH {TOKENS}, {DICT}, {_PROF} SELECT a.g AS lang, round(abs(a.h_word - r.h_word), 6) AS gap_h, round(abs(a.exponent - r.exponent), 6) AS gap_zipf, round(abs(a.ttr - r.ttr), 6) AS gap_ttr, a.codebook,
abs(a.h_word - r.h_word) < {_TOLERANCE['h_word']} AND abs(a.exponent - r.exponent) < {_TOLERANCE['exponent']} AND abs(a.ttr - r.ttr) < {_TOLERANCE['ttr']} AS compatible FROM pf a, (SELECT * FROM pf WHERE g = 'reference') r WHERE a.g <> 'reference'""")
def codebook_compatibility(spark, sf):
    """Whether a language could be the reference in code, word for word: gaps of word entropy, Zipf exponent and share of types, and the size of the code book that covers nine tenths."""
    p = _profiles(spark, sf)
    r = p.where("g = 'reference'").select(*(F.col(c).alias(f"r_{c}") for c in _TOLERANCE))
    x = p.where("g <> 'reference'").join(F.broadcast(r))
    gap = {c: F.abs(F.col(c) - F.col(f"r_{c}")) for c in _TOLERANCE}
    fits = (gap["h_word"] < _TOLERANCE["h_word"]) & (gap["exponent"] < _TOLERANCE["exponent"]) & (gap["ttr"] < _TOLERANCE["ttr"])
    return x.select(F.col("g").alias("lang"), r6(gap["h_word"]).alias("gap_h"), r6(gap["exponent"]).alias("gap_zipf"), r6(gap["ttr"]).alias("gap_ttr"), "codebook", fits.alias("compatible"))


@query(f"""WITH {DICT}, ln AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT list_filter(regexp_split_to_array(lower(line), '[^a-z]+'), lambda x: x <> '') AS t FROM ln),
w AS (SELECT tok, count(*) AS c FROM (SELECT unnest(t) AS tok FROM t WHERE len(t) BETWEEN 1 AND 3) GROUP BY 1), n AS (SELECT DISTINCT tok AS name, {skeleton('tok')} AS skel FROM btok WHERE length(tok) >= 5)
SELECT w.tok AS label, w.c, n.name FROM w JOIN n ON n.skel = {skeleton('w.tok')} WHERE n.skel <> '' AND length(w.tok) >= 4""")
def label_name_pairs(spark, sf):
    """Words of labels with the names they could be: those of the same skeleton."""
    t = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(token_array(F.col("line")).alias("t")).where(F.size("t").between(1, 3))
    w = t.select(F.explode("t").alias("label")).where("length(label) >= 4").groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    names = dictionary(spark, sf).where("length(word) >= 5").select(F.col("word").alias("name"), ft.skeleton(F.col("word")).alias("skel")).where("skel <> ''")
    return w.withColumn("skel", ft.skeleton(F.col("label"))).join(names, "skel").select("label", "c", "name")


_SWEEP = [1, 2, 3, 5, 8]


@query(f"""WITH {TOKENS}, {DICT}, rn AS (SELECT unnest({_SWEEP}) AS run), t AS (SELECT tok, count(*) AS c FROM tokens GROUP BY 1), x AS (SELECT run, tok, c, row_number() OVER (PARTITION BY run ORDER BY c DESC, tok) AS rank FROM t, rn WHERE c >= run),
p AS (SELECT run, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, -regr_slope(ln(c + 1e-10), ln(rank)) AS z, count(*) * 1.0 / sum(c) AS ttr FROM x GROUP BY 1),
r0 AS (SELECT freq AS c, row_number() OVER (ORDER BY freq DESC, word) AS rank FROM dict), r AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h, -regr_slope(ln(c + 1e-10), ln(rank)) AS z, count(*) * 1.0 / sum(c) AS ttr FROM r0)
SELECT run, round(p.h, 6) AS h, round(p.z, 6) AS exponent, round(p.ttr, 6) AS ttr, CAST(abs(p.h - r.h) < 1 AS INT) + CAST(abs(p.z - r.z) < 0.2 AS INT) + CAST(abs(p.ttr - r.ttr) < 0.05 AS INT) AS quick,
round(sqrt(pow(p.h - r.h, 2) + 2 * pow(p.z - r.z, 2) + 1.5 * pow(p.ttr - r.ttr, 2)), 6) AS distance FROM p, r""")
def sweep_scoring(spark, sf):
    """Runs over a least word count: how many of three measures match the reference at a glance, and the whole distance. Words are counted once for all runs."""
    runs = F.array(*map(F.lit, _SWEEP))
    t = stats.word_counts(token_docs(spark, sf)).select("tok", "c", F.explode(F.filter(runs, lambda r: r <= F.col("c"))).alias("run"))
    ref = dictionary(spark, sf).select(F.col("word").alias("tok"), F.col("freq").alias("c"), F.lit(0).alias("run"))
    both = t.unionByName(ref)
    p = stats.zipf(both, "run").select("run", "exponent", "ttr").join(both.groupBy("run").agg(stats.bits("c").alias("h")), "run")
    r = p.where("run = 0").select(F.col("h").alias("rh"), F.col("exponent").alias("rz"), F.col("ttr").alias("rt"))
    dh, dz, dt = F.col("h") - F.col("rh"), F.col("exponent") - F.col("rz"), F.col("ttr") - F.col("rt")
    quick = (F.abs(dh) < 1).cast("int") + (F.abs(dz) < 0.2).cast("int") + (F.abs(dt) < 0.05).cast("int")
    x = p.where("run > 0").join(F.broadcast(r))
    return x.select("run", r6("h").alias("h"), r6("exponent").alias("exponent"), r6("ttr").alias("ttr"), quick.alias("quick"), r6(F.sqrt(dh * dh + 2 * dz * dz + 1.5 * dt * dt)).alias("distance"))


_PROPS = "p AS (SELECT item_id, ['hot_dry', 'hot_wet', 'cold_dry', 'cold_wet'][item_id % 4 + 1] AS humoral, ['high', 'moderate', 'low'][item_id % 3 + 1] AS confidence, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS section FROM benchmark WHERE text IS NOT NULL)"


@query(f"""WITH {_PROPS} SELECT 'humoral' AS property, humoral AS value, count(*) AS items, min(item_id) AS first_item FROM p WHERE confidence = 'high' GROUP BY 2 UNION ALL
SELECT 'section', section, count(*), min(item_id) FROM p GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*), min(item_id) FROM p WHERE confidence <> 'low' GROUP BY 2""")
def items_by_property(spark, sf):
    """Reference items by three properties: temper among the sure ones, section, and confidence but for the low."""
    b = table(spark, sf, "benchmark").where("text is not null")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("item_id") % len(names)).cast("int"))
    p = b.select("item_id", pick(["hot_dry", "hot_wet", "cold_dry", "cold_wet"]).alias("humoral"), pick(["high", "moderate", "low"]).alias("confidence"), F.when(F.length("text") < 200, "short").otherwise("long").alias("section"))
    one = lambda name, rows: rows.select(F.lit(name).alias("property"), F.col(name).alias("value"), "item_id")
    rows = one("humoral", p.where("confidence = 'high'")).unionByName(one("section", p)).unionByName(one("confidence", p.where("confidence <> 'low'")))
    return rows.groupBy("property", "value").agg(F.count(F.lit(1)).alias("items"), F.min("item_id").alias("first_item"))


#: Constraints on a language's profile: name, measure, least and most.
CONSTRAINTS = [("entropy", "h_word", 1.0, 9.0), ("slope", "exponent", 0.6, 1.4), ("variety", "ttr", 0.0, 0.2), ("book", "codebook", 10.0, 5000.0)]


@query(f"""WITH {TOKENS}, {DICT}, {_PROF}, k AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{c}', {a}, {b})" for n, c, a, b in CONSTRAINTS)}) t(name, measure, low, high)),
u AS (UNPIVOT (SELECT g, CAST(h_word AS DOUBLE) AS h_word, CAST(exponent AS DOUBLE) AS exponent, CAST(ttr AS DOUBLE) AS ttr, CAST(codebook AS DOUBLE) AS codebook FROM pf) ON h_word, exponent, ttr, codebook INTO NAME measure VALUE v)
SELECT u.g AS candidate, count(*) AS checks, count(*) FILTER (v BETWEEN low AND high) AS passed, bool_and(v BETWEEN low AND high) AS survives, min(k.name) FILTER (NOT v BETWEEN low AND high) AS first_failed FROM u JOIN k USING (measure) GROUP BY 1""")
def constraint_check(spark, sf):
    """Candidates against a table of constraints: which pass all, and the first that each fails."""
    u = _profiles(spark, sf).select("g", *(F.col(c).cast("double").alias(c) for _, c, _, _ in CONSTRAINTS)).unpivot("g", [c for _, c, _, _ in CONSTRAINTS], "measure", "v")
    k = spark.createDataFrame(CONSTRAINTS, "name string, measure string, low double, high double")
    ok = F.col("v").between(F.col("low"), F.col("high"))
    g = u.join(F.broadcast(k), "measure").groupBy(F.col("g").alias("candidate"))
    return g.agg(F.count(F.lit(1)).alias("checks"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("survives"), F.min(F.when(~ok, F.col("name"))).alias("first_failed"))


@query()
def rank_pairs_unused_first(spark, sf):
    """The 200 most frequent words, in order, each with five reference words of like rank: those not yet first for another word come first, then the nearest."""
    v = stats.top(stats.word_counts(token_docs(spark, sf)), 200).collect()
    l = stats.top(dictionary(spark, sf).select(F.col("word").alias("tok"), F.col("freq").alias("c")), 205).collect()  # both lists are of fixed size
    rows = search.rank_pairs([r["tok"] for r in v], [r["tok"] for r in l], window=5, keep=5)
    return spark.createDataFrame(rows, "tok string, place int, word string, gap int, confidence string")


@query()
def choice_carrier(spark, sf):
    """A message hidden in the choice between the two likeliest next words, written from all letters of each document and read back."""
    from stratalex.operators.decode import bounded

    ship_package(spark)
    w = Window.partitionBy("w1").orderBy(F.desc("c"), "w2")
    two = reference_bigrams(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 2").orderBy("w1", "k")
    after: dict[str, list[str]] = {}
    for r in bounded(two.select("w1", "w2", "k"), 2 * DICTIONARY_WORDS, "the carrier's table"):
        after.setdefault(r["w1"], []).append(r["w2"])
    docs = token_docs(spark, sf).select("doc_id", F.array_join("toks", "").alias("message"))
    return search.carried(docs, after)


@query(f"""WITH {TOKENS}, {DICT}, i AS (SELECT {skeleton('word')} AS skel, count(*) AS words FROM dict GROUP BY 1 HAVING {skeleton('word')} <> ''), t AS (SELECT {skeleton('tok')} AS skel, count(*) AS c FROM tokens GROUP BY 1)
SELECT CASE WHEN i.words IS NULL THEN 0 ELSE least(i.words, 16) END AS candidates, count(*) AS skeletons, CAST(sum(t.c) AS BIGINT) AS tokens FROM t LEFT JOIN i ON i.skel = t.skel GROUP BY 1""")
def unicity_profile(spark, sf):
    """Tokens by how many dictionary words their skeleton leaves open: 16 stands for more than the solver's limit of 15."""
    i = _index(spark, sf).groupBy("skel").agg(F.count(F.lit(1)).alias("words"))
    t = stats.word_counts(token_docs(spark, sf)).groupBy(ft.skeleton(F.col("tok")).alias("skel")).agg(F.sum("c").alias("c"))
    x = t.join(i, "skel", "left")
    return x.groupBy(F.when(F.col("words").isNull(), 0).otherwise(F.least("words", F.lit(16))).cast("long").alias("candidates")).agg(F.count(F.lit(1)).alias("skeletons"), F.sum("c").alias("tokens"))
