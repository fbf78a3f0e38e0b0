"""Queries of composed analyses: tiers, vocabularies, tests, null models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as ft
from stratalex.operators import nulls, stats
from stratalex.plans.registry import query
from stratalex.plans.sqltext import DICT, PAIRS, TOKENS, pos_tag, skeleton
from stratalex.session import ship_package
from stratalex.sources.tables import dictionary, explode_tokens, neighbours, reference_bigrams, table, token_array, token_docs

r6 = lambda c: F.round(c, 6)


@query(f"""WITH {TOKENS}, n AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2)
SELECT lang, count(*) FILTER (c >= 2) AS tier1_types, CAST(coalesce(sum(c) FILTER (c >= 2), 0) AS BIGINT) AS tier1_tokens, count(*) FILTER (c < 2) AS singletons FROM n GROUP BY 1""")
def tier_split(spark, sf):
    n = stats.word_counts(token_docs(spark, sf), "lang")
    return n.groupBy("lang").agg(F.count_if(F.col("c") >= 2).alias("tier1_types"), F.coalesce(F.sum(F.when(F.col("c") >= 2, F.col("c"))), F.lit(0)).alias("tier1_tokens"), F.count_if(F.col("c") < 2).alias("singletons"))


@query(f"""WITH {TOKENS}, {PAIRS}, t AS (SELECT tok, count(*) >= 2 AS f FROM tokens GROUP BY 1), x AS (SELECT a.f AS f1, b.f AS f2, count(*) AS n FROM pairs p JOIN t a ON a.tok = p.w1 JOIN t b ON b.tok = p.w2 GROUP BY 1, 2),
m AS (SELECT f1, f2, n, sum(n) OVER (PARTITION BY f1) * 1.0 * sum(n) OVER (PARTITION BY f2) / sum(n) OVER () AS e FROM x)
SELECT CASE WHEN f1 THEN 1 ELSE 2 END AS tier1, CASE WHEN f2 THEN 1 ELSE 2 END AS tier2, n, round(e, 4) AS expected, round(n / e, 6) AS enrichment, abs(n - e) > 2 * sqrt(e) AS unusual FROM m""")
def tier_transitions(spark, sf):
    docs = token_docs(spark, sf)
    t = stats.word_counts(docs).select("tok", (F.col("c") >= 2).alias("f"))
    p = stats.word_pairs(docs)
    x = p.join(t.select(F.col("tok").alias("w1"), F.col("f").alias("f1")), "w1").join(t.select(F.col("tok").alias("w2"), F.col("f").alias("f2")), "w2")
    x = x.groupBy("f1", "f2").agg(F.sum("n").alias("n"))
    s = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    m = x.withColumn("e", s("f1") * s("f2") / s())
    tier = lambda c: F.when(F.col(c), 1).otherwise(2)
    return m.select(tier("f1").alias("tier1"), tier("f2").alias("tier2"), "n", F.round("e", 4).alias("expected"), r6(F.col("n") / F.col("e")).alias("enrichment"), (F.abs(F.col("n") - F.col("e")) > 2 * F.sqrt("e")).alias("unusual"))


_WH = """{n} AS (SELECT lang, w1, w2, count(*) AS n FROM {src} WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
{h} AS (SELECT lang, j - x AS h FROM (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS j FROM {n} GROUP BY 1) JOIN (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS x FROM (SELECT lang, w1, sum(n) AS n FROM {n} GROUP BY 1, 2) GROUP BY 1) USING (lang))"""


@query(f"""WITH {TOKENS}, {PAIRS}, t AS (SELECT tok FROM tokens GROUP BY 1 HAVING count(*) >= 2), fp AS (SELECT lang, tok AS w1, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tokens WHERE tok IN (SELECT tok FROM t)),
{_WH.format(n='na', h='ha', src='pairs')}, {_WH.format(n='nb', h='hb', src='fp')} SELECT lang, round(ha.h, 6) AS h_all, round(hb.h, 6) AS h_frequent, round(ha.h - hb.h, 6) AS change FROM ha JOIN hb USING (lang)""")
def frequent_only_entropy(spark, sf):
    docs = token_docs(spark, sf)
    frequent = stats.word_counts(docs).where("c >= 2").select("tok")
    kept = explode_tokens(docs).select("doc_id", "lang", "pos", "tok").join(frequent, "tok", "left_semi")
    seq = kept.withColumn("w2", F.lead("tok").over(Window.partitionBy("doc_id").orderBy("pos"))).where("w2 is not null")
    b = stats.word_conditional_entropy(seq.groupBy("lang", F.col("tok").alias("w1"), "w2").agg(F.count(F.lit(1)).alias("n")), "lang").select("lang", F.col("h").alias("hb"))
    a = stats.word_conditional_entropy(stats.word_pairs(docs, "lang"), "lang").select("lang", F.col("h").alias("ha"))
    return a.join(b, "lang").select("lang", r6(F.col("ha")).alias("h_all"), r6(F.col("hb")).alias("h_frequent"), r6(F.col("ha") - F.col("hb")).alias("change"))


@query(f"""WITH {TOKENS}, hit AS (SELECT doc_id, pos FROM tokens WHERE tok = 'the'), w AS (SELECT t.tok FROM hit h JOIN tokens t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 2 AND h.pos + 2 AND t.pos <> h.pos),
j AS (SELECT tok, count(*) AS c FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), u AS (SELECT tok, count(*) AS f FROM tokens GROUP BY 1), n AS (SELECT count(*) AS t FROM tokens), q AS (SELECT count(*) AS f FROM hit)
SELECT j.tok, j.c, round(log2(j.c * 1.0 / n.t / ((q.f * 1.0 / n.t) * (u.f * 1.0 / n.t))), 6) AS pmi FROM j JOIN u USING (tok), n, q""")
def pmi_collocates(spark, sf):
    docs = token_docs(spark, sf)
    both = F.concat(neighbours(F.col("toks"), 1), neighbours(F.col("toks"), 2))
    near = F.flatten(F.transform(F.filter(both, lambda b: (b["w1"] == "the") | (b["w2"] == "the")), lambda b: F.concat(
        F.when(b["w1"] == "the", F.array(b["w2"])).otherwise(F.array().cast("array<string>")), F.when(b["w2"] == "the", F.array(b["w1"])).otherwise(F.array().cast("array<string>")))))
    j = stats.top(docs.select(F.explode(near).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c")), 20)
    u = stats.word_counts(docs).withColumnRenamed("c", "f")
    tot = u.agg(F.sum("f").alias("t"), F.sum(F.when(F.col("tok") == "the", F.col("f"))).alias("q"))
    x = u.join(F.broadcast(j), "tok").join(F.broadcast(tot))
    return x.select("tok", "c", r6(F.log2(F.col("c") * F.col("t") / (F.col("q") * F.col("f")))).alias("pmi"))


_WD = "wd AS (SELECT tok, doc_id, count(*) AS n FROM tokens GROUP BY 1, 2)"


@query(f"""WITH {TOKENS}, {_WD}, nd AS (SELECT count(DISTINCT doc_id) AS docs FROM tokens), h AS (SELECT tok, sum(n) AS c, count(*) AS in_docs, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM wd GROUP BY 1 HAVING sum(n) >= 5)
SELECT tok, CAST(c AS BIGINT) AS c, in_docs, round(1 - h / log2(docs), 6) AS specificity FROM h, nd""")
def page_specificity(spark, sf):
    """1 - H(word over documents) / log2(documents)."""
    docs = token_docs(spark, sf)
    n = docs.where(F.size("toks") > 0).agg(F.count(F.lit(1)).alias("docs"))
    wd = stats.word_counts(docs, "doc_id").groupBy("tok").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("in_docs"), stats.bits("c").alias("h")).where("t >= 5")
    return wd.join(F.broadcast(n)).select("tok", F.col("t").alias("c"), "in_docs", r6(1 - F.col("h") / F.log2(F.col("docs").cast("double"))).alias("specificity"))


@query(f"""WITH {TOKENS}, s AS (SELECT tok, source, count(*) AS n FROM tokens GROUP BY 1, 2), ns AS (SELECT count(DISTINCT source) AS k FROM documents),
w AS (SELECT tok, sum(n) AS c, count(*) * 1.0 / max(k) AS u, max(n) * 1.0 / sum(n) AS top FROM s, ns GROUP BY 1 HAVING sum(n) >= 10)
SELECT tok, CAST(c AS BIGINT) AS c, round(ln(c + 1) / (length(tok) + 1) * u, 6) AS functional, round(ln(c + 1) * (1 - u) * top * length(tok), 6) AS content,
  CASE WHEN ln(c + 1) / (length(tok) + 1) * u > ln(c + 1) * (1 - u) * top * length(tok) THEN 'functional' ELSE 'content' END AS kind FROM w""")
def functional_content_score(spark, sf):
    k = table(spark, sf, "documents").select("source").distinct().agg(F.count("source").alias("k"))
    s = stats.word_counts(token_docs(spark, sf), "source").groupBy("tok").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("in_"), F.max("c").alias("m")).where("t >= 10").join(F.broadcast(k))
    u = F.col("in_") / F.col("k")
    fn = F.log(F.col("t") + 1) / (F.length("tok") + 1) * u
    ct = F.log(F.col("t") + 1) * (1 - u) * (F.col("m") / F.col("t")) * F.length("tok")
    return s.select("tok", F.col("t").alias("c"), r6(fn).alias("functional"), r6(ct).alias("content"), F.when(fn > ct, "functional").otherwise("content").alias("kind"))


_V = "v AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2)"


@query(f"""WITH {TOKENS}, {_V}, n AS (SELECT lang, count(*) AS n FROM v GROUP BY 1), s AS (SELECT x.lang AS a, y.lang AS b, count(*) AS shared FROM v x JOIN v y ON x.tok = y.tok AND x.lang < y.lang GROUP BY 1, 2)
SELECT a, b, shared, p.n - shared AS only_a, q.n - shared AS only_b, round(shared * 1.0 / (p.n + q.n - shared), 6) AS jaccard FROM s JOIN n p ON p.lang = a JOIN n q ON q.lang = b""")
def vocab_overlap(spark, sf):
    v = stats.word_counts(token_docs(spark, sf), "lang")
    # pairs of languages within a word's row: as many rows as words, and no join of the vocabulary with itself
    sets = v.groupBy("tok").agg(F.sort_array(F.collect_set("lang")).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = sets.select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("shared"))
    n = v.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    x = shared.join(n.select(F.col("lang").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("lang").alias("b"), F.col("n").alias("nb")), "b")
    return x.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), r6(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


@query(f"WITH {TOKENS}, {_V} SELECT lang, count(*) FILTER (c = 1) AS hapax, count(*) AS types, round(count(*) FILTER (c = 1) * 1.0 / count(*), 6) AS share FROM v GROUP BY 1")
def hapax(spark, sf):
    v = stats.word_counts(token_docs(spark, sf), "lang")
    return v.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("hapax"), F.count(F.lit(1)).alias("types"), r6(F.count_if(F.col("c") == 1) / F.count(F.lit(1))).alias("share"))


@query(f"WITH {TOKENS} SELECT tok FROM tokens WHERE lang = 'en' INTERSECT SELECT tok FROM tokens WHERE lang = 'fr' INTERSECT SELECT tok FROM tokens WHERE lang = 'de' INTERSECT SELECT tok FROM tokens WHERE lang = 'es'")
def universal_vocab(spark, sf):
    v = stats.word_counts(token_docs(spark, sf), "lang")
    return v.where(F.col("lang").isin("en", "fr", "de", "es")).groupBy("tok").agg(F.count(F.lit(1)).alias("k")).where("k = 4").select("tok")


@query(f"WITH {TOKENS}, {DICT} SELECT word FROM dict EXCEPT SELECT tok FROM tokens WHERE lang = 'en'")
def vocab_difference(spark, sf):
    return dictionary(spark, sf).select("word").subtract(token_docs(spark, sf).where("lang = 'en'").select(F.explode("toks").alias("word")))


@query(f"""WITH {TOKENS}, g AS (SELECT tok, count(DISTINCT lang) AS k, count(*) AS c FROM tokens GROUP BY 1)
SELECT CASE WHEN k >= 3 THEN 'universal' WHEN k = 2 THEN 'moderate' ELSE 'specific' END AS kind, count(*) AS types, CAST(sum(c) AS BIGINT) AS total FROM g GROUP BY 1""")
def group_specific_words(spark, sf):
    g = stats.word_counts(token_docs(spark, sf), "lang").groupBy("tok").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"))
    kind = F.when(F.col("k") >= 3, "universal").when(F.col("k") == 2, "moderate").otherwise("specific")
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("total"))


_LP = "lp AS (SELECT lang, length(tok) AS len, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang) AS p FROM tokens GROUP BY 1, 2)"


@query(f"WITH {TOKENS}, {_LP} SELECT a.lang AS a, b.lang AS b, round(sum(least(a.p, b.p)), 6) AS overlap FROM lp a JOIN lp b ON a.len = b.len AND a.lang < b.lang GROUP BY 1, 2")
def distribution_overlap(spark, sf):
    n = stats.word_counts(token_docs(spark, sf), "lang").groupBy("lang", F.length("tok").alias("len")).agg(F.sum("c").alias("c"))
    p = n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("lang")))
    a, b = p.select(F.col("lang").alias("a"), "len", F.col("p").alias("pa")), p.select(F.col("lang").alias("b"), "len", F.col("p").alias("pb"))
    return a.join(b, "len").where("a < b").groupBy("a", "b").agg(r6(F.sum(F.least("pa", "pb"))).alias("overlap"))


@query(f"""WITH {TOKENS}, x AS (SELECT length(tok) AS len, count(*) FILTER (lang = 'en') AS e, count(*) FILTER (lang = 'de') AS g FROM tokens WHERE lang IN ('en', 'de') GROUP BY 1),
f AS (SELECT sum(e) OVER (ORDER BY len) * 1.0 / sum(e) OVER () AS f1, sum(g) OVER (ORDER BY len) * 1.0 / sum(g) OVER () AS f2 FROM x), k AS (SELECT max(abs(f1 - f2)) AS d FROM f), n AS (SELECT sum(e) AS n1, sum(g) AS n2 FROM x),
l AS (SELECT d, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM k, n)
SELECT round(d, 6) AS d, round(least(greatest(2 * (exp(-2 * lam * lam) - exp(-8 * lam * lam) + exp(-18 * lam * lam)), 0), 1), 6) AS p FROM l""")
def ks_two_sample(spark, sf):
    """Largest gap of two cumulative distributions of word length, with its asymptotic p: a table of lengths, not of words."""
    n = stats.word_counts(token_docs(spark, sf).where(F.col("lang").isin("en", "de")), "lang")
    one = lambda l: F.sum(F.when(F.col("lang") == l, F.col("c")).otherwise(0))
    x = n.groupBy(F.length("tok").alias("len")).agg(one("en").alias("e"), one("de").alias("g"))
    w = Window.orderBy("len")
    f = x.select(F.abs(F.sum("e").over(w) / F.sum("e").over(Window.partitionBy()) - F.sum("g").over(w) / F.sum("g").over(Window.partitionBy())).alias("gap"), "e", "g")
    k = f.agg(F.max("gap").alias("d"), F.sum("e").alias("a"), F.sum("g").alias("b"))
    root = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b")))
    lam = (root + 0.12 + 0.11 / root) * F.col("d")
    p = 2 * (F.exp(-2 * lam * lam) - F.exp(-8 * lam * lam) + F.exp(-18 * lam * lam))
    return k.select(r6(F.col("d")).alias("d"), r6(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).alias("p"))


@query(f"""WITH {TOKENS}, o AS (SELECT lang, least(length(tok) // 3, 3) AS bucket, count(*) AS n FROM tokens GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY lang) * 1.0 * sum(n) OVER (PARTITION BY bucket) / sum(n) OVER () AS e FROM o)
SELECT round(sum((n - e) * (n - e) / e), 4) AS chi2, (SELECT (count(DISTINCT lang) - 1) * (count(DISTINCT bucket) - 1) FROM o) AS df FROM e""")
def chi_squared(spark, sf):
    o = stats.word_counts(token_docs(spark, sf), "lang").groupBy("lang", F.least(F.floor(F.length("tok") / 3), F.lit(3)).alias("bucket")).agg(F.sum("c").alias("n"))
    s = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    e = o.withColumn("e", s("lang") * s("bucket") / s())
    return e.agg(F.round(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")), 4).alias("chi2"), ((F.count_distinct("lang") - 1) * (F.count_distinct("bucket") - 1)).alias("df"))


_FAM = "CASE WHEN tok LIKE '%ing' THEN 'ing' WHEN tok LIKE '%ed' THEN 'ed' WHEN tok LIKE '%er' THEN 'er' WHEN tok LIKE '%tion' THEN 'tion' ELSE 'other' END"


def _family():
    t = F.col("tok")
    return F.when(t.endswith("ing"), "ing").when(t.endswith("ed"), "ed").when(t.endswith("er"), "er").when(t.endswith("tion"), "tion").otherwise("other")


@query(f"""WITH {TOKENS}, s AS (SELECT doc_id, {_FAM} AS family, count(*) AS c FROM tokens GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1),
f AS (SELECT unnest(['ing', 'ed', 'er', 'tion', 'other']) AS family), g AS (SELECT f.family, coalesce(s.c, 0) * 1.0 / n.n AS share FROM n CROSS JOIN f LEFT JOIN s ON s.doc_id = n.doc_id AND s.family = f.family)
SELECT family, round(avg(share), 6) AS mean, round(stddev_pop(share) / avg(share), 6) AS cv, stddev_pop(share) / avg(share) < 0.15 AS constant FROM g GROUP BY 1""")
def family_variation(spark, sf):
    """Share of word families in documents, and how it varies from one to the next."""
    names = ["ing", "ed", "er", "tion", "other"]
    s = stats.word_counts(token_docs(spark, sf), "doc_id").withColumn("family", _family())
    p = s.groupBy("doc_id").agg(F.sum("c").alias("n"), *(F.sum(F.when(F.col("family") == f, F.col("c")).otherwise(0)).alias(f) for f in names))
    long = p.select(F.explode(F.array(*(F.struct(F.lit(f).alias("family"), (F.col(f) / F.col("n")).alias("share")) for f in names))).alias("x")).select("x.*")
    cv = F.try_divide(F.stddev_pop("share"), F.avg("share"))
    return long.groupBy("family").agg(r6(F.avg("share")).alias("mean"), r6(cv).alias("cv"), (cv < 0.15).alias("constant"))


_LEX = "lex AS (SELECT word, min(item_id % 12) AS field FROM (SELECT tok AS word, item_id FROM btok) GROUP BY 1)"


def lexicon(spark, sf):
    """(word, field): twelve fields; a word in several takes that of least number, the most specific."""
    b = table(spark, sf, "benchmark").select((F.col("item_id") % 12).alias("field"), F.explode(token_array(F.col("text"))).alias("word"))
    return b.groupBy("word").agg(F.min("field").alias("field"))


@query(f"""WITH {TOKENS}, {DICT}, {_LEX}, h AS (SELECT t.doc_id, l.field, count(*) AS n FROM tokens t JOIN lex l ON l.word = t.tok GROUP BY 1, 2),
d2 AS (SELECT doc_id, sum(n) AS known, sum(n) FILTER (field < 10) AS content, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM h GROUP BY 1)
SELECT doc_id, CAST(known AS BIGINT) AS known, CASE WHEN known >= 5 THEN round(coalesce(content, 0) * 1.0 / known, 6) END AS rate, CASE WHEN known >= 5 THEN round(h / log2(12), 6) END AS concentration FROM d2""")
def lexicon_rate(spark, sf):
    h = stats.word_counts(token_docs(spark, sf), "doc_id").join(lexicon(spark, sf).withColumnRenamed("word", "tok"), "tok").groupBy("doc_id", "field").agg(F.sum("c").alias("n"))
    d = h.groupBy("doc_id").agg(F.sum("n").alias("known"), F.sum(F.when(F.col("field") < 10, F.col("n")).otherwise(0)).alias("content"), stats.bits("n").alias("h"))
    enough = F.col("known") >= 5
    return d.select("doc_id", "known", F.when(enough, r6(F.col("content") / F.col("known"))).alias("rate"), F.when(enough, r6(F.col("h") / F.log2(F.lit(12.0)))).alias("concentration"))


@query(f"""WITH {TOKENS}, {DICT}, x AS (SELECT lang, tok, count(*) AS c, max({skeleton('tok')}) AS skel FROM tokens GROUP BY 1, 2)
SELECT lang, count(*) AS types, CAST(sum(c) AS BIGINT) AS total, round(sum(c) FILTER ({pos_tag('tok')} IN ('PREP', 'CONJ', 'ADV', 'DET')) * 1.0 / sum(c), 6) AS function_share,
  round(sum(c) FILTER (tok IN (SELECT word FROM dict)) * 1.0 / sum(c), 6) AS known_share, round(sum(c * CASE WHEN skel = '' THEN 0 ELSE len(string_split(skel, '-')) END) * 1.0 / sum(c), 6) AS mean_segments FROM x GROUP BY 1""")
def content_metrics(spark, sf):
    x = stats.word_counts(token_docs(spark, sf), "lang").join(dictionary(spark, sf).select(F.col("word").alias("tok"), F.lit(1).alias("known")), "tok", "left")
    share = lambda c: r6(F.sum(F.when(c, F.col("c"))) / F.sum("c"))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("total"), share(ft.pos_tag(F.col("tok")).isin("PREP", "CONJ", "ADV", "DET")).alias("function_share"),
                                 share(F.col("known") == 1).alias("known_share"), r6(F.sum(F.col("c") * ft.segments(ft.skeleton(F.col("tok")))) / F.sum("c")).alias("mean_segments"))


@query(f"""WITH {TOKENS}, a AS (SELECT tok, count(*) AS c FROM tokens WHERE lang = 'en' GROUP BY 1), {DICT}, ra AS (SELECT c * 1.0 / sum(c) OVER () AS p, row_number() OVER (ORDER BY c DESC, tok) AS r FROM a),
rb AS (SELECT freq * 1.0 / sum(freq) OVER () AS p, row_number() OVER (ORDER BY freq DESC, word) AS r FROM dict)
SELECT round(corr(ra.p, rb.p), 6) AS r, count(*) AS ranks FROM ra JOIN rb USING (r) WHERE r <= 20""")
def frequency_rank_correlation(spark, sf):
    def best(c):
        t = c.agg(F.sum("c").alias("t"))
        top = stats.top(c, 20).withColumn("r", F.row_number().over(Window.orderBy(F.desc("c"), "tok")))
        return top.join(F.broadcast(t)).select("r", (F.col("c") / F.col("t")).alias("p"))

    a = best(stats.word_counts(token_docs(spark, sf).where("lang = 'en'")))
    b = best(dictionary(spark, sf).select(F.col("word").alias("tok"), F.col("freq").alias("c")))
    return a.join(b.withColumnRenamed("p", "q"), "r").agg(r6(F.corr("p", "q")).alias("r"), F.count(F.lit(1)).alias("ranks"))


@query("""SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 5000 AND CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) BETWEEN 0 AND 9 GROUP BY 1, 2""")
def page_filter(spark, sf):
    d = table(spark, sf, "documents").where(F.col("lang").isin("en", "de") & F.col("n_chars").between(200, 5000))
    d = d.where(F.regexp_extract("source", "([0-9]+)", 1).cast("int").between(0, 9))
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("""WITH x AS (SELECT source, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS n FROM documents)
SELECT CASE WHEN n BETWEEN 0 AND 4 THEN 'herbal' WHEN n BETWEEN 5 AND 8 THEN 'astral' WHEN n BETWEEN 9 AND 14 THEN 'balneal' ELSE 'recipes' END AS section, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS hand, count(*) AS docs FROM x GROUP BY 1, 2""")
def inferred_sections(spark, sf):
    """Attributes from ranges of a number in the name."""
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    section = F.when(n.between(0, 4), "herbal").when(n.between(5, 8), "astral").when(n.between(9, 14), "balneal").otherwise("recipes")
    return table(spark, sf, "documents").groupBy(section.alias("section"), F.when(n % 2 == 0, "A").otherwise("B").alias("hand")).agg(F.count(F.lit(1)).alias("docs"))


_LN = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
lt AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(lower(line), '[^a-z]+'), lambda x: x <> '')) AS n FROM ln)"""


@query(f"""WITH {_LN}, g AS (SELECT doc_id, i, n, sum(CASE WHEN prev IS NULL OR prev = 0 OR prev > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM lt)),
p AS (SELECT doc_id, para, count(*) AS lines, sum(n) AS words FROM g WHERE n > 0 GROUP BY 1, 2)
SELECT doc_id, count(*) AS paragraphs, CAST(max(words) AS BIGINT) AS longest, round(avg(words), 6) AS mean_words FROM p GROUP BY 1""")
def paragraphs(spark, sf):
    """A paragraph ends at a blank line or after a line of over 15 words."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.size(token_array(F.col("line"))).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("i")
    prev = F.lag("n").over(w)
    g = lines.withColumn("new", F.when(prev.isNull() | (prev == 0) | (prev > 15), 1).otherwise(0)).withColumn("para", F.sum("new").over(w))
    p = g.where("n > 0").groupBy("doc_id", "para").agg(F.sum("n").alias("words"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.max("words").alias("longest"), r6(F.avg("words")).alias("mean_words"))


@query(f"""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT list_filter(regexp_split_to_array(lower(line), '[^a-z]+'), lambda x: x <> '') AS t FROM ln)
SELECT CASE WHEN len(t) <= 3 THEN array_to_string(t, ' ') ELSE t[1] END AS label, CASE WHEN len(t) <= 3 THEN 'short' ELSE 'first' END AS kind, count(*) AS c FROM t WHERE len(t) BETWEEN 1 AND 3 OR len(t) > 30 GROUP BY 1, 2""")
def short_line_labels(spark, sf):
    """Lines of one to three words, and the first word of long lines."""
    t = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(token_array(F.col("line")).alias("t"))
    t = t.where(F.size("t").between(1, 3) | (F.size("t") > 30))
    short = F.size("t") <= 3
    return t.groupBy(F.when(short, F.array_join("t", " ")).otherwise(F.get("t", F.lit(0))).alias("label"), F.when(short, "short").otherwise("first").alias("kind")).agg(F.count(F.lit(1)).alias("c"))


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || doc_id), doc_id) AS m FROM documents)
SELECT source, doc_id FROM r WHERE a <= 5 OR b <= 5 OR m <= 4""")
def stratified_sample(spark, sf):
    """The five longest and shortest of each source and four by a hash; three bounded heaps a source, no sort of all rows."""
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars", F.md5(F.concat(F.lit("s|"), F.col("doc_id").cast("string"))).alias("h"))
    out = None
    for order, n in (((F.desc("n_chars"), "doc_id"), 5), (("n_chars", "doc_id"), 5), (("h", "doc_id"), 4)):
        w = Window.partitionBy("source").orderBy(*order)
        part = d.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("source", "doc_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


@query()
def shuffle_null_pvalue(spark, sf):
    """Known word pairs of every document of two words or more against a thousand orders of its words."""
    ship_package(spark)
    docs = token_docs(spark, sf).where(F.size("toks") > 1).select("doc_id", "toks")
    n = nulls.shuffle_null(docs, reference_bigrams(spark, sf).select("w1", "w2"), trials=1000)
    return n.select("doc_id", "hits", r6(F.col("null_mean")).alias("null_mean"), r6(F.col("p")).alias("p"))


@query(f"""WITH {TOKENS}, {DICT}, s AS (SELECT doc_id, toks, len(toks) AS n FROM d WHERE len(toks) > 1), e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM s),
c AS (SELECT doc_id, tok, count(*) AS c FROM e GROUP BY 1, 2), bg AS (SELECT w1, w2 FROM bigram),
x AS (SELECT doc_id, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM e), h AS (SELECT x.doc_id, count(*) AS hits FROM x JOIN bg ON bg.w1 = x.tok AND bg.w2 = x.nxt GROUP BY 1),
m AS (SELECT a.doc_id, sum(a.c * (b.c - CASE WHEN a.tok = b.tok THEN 1 ELSE 0 END)) AS ways FROM c a JOIN bg ON bg.w1 = a.tok JOIN c b ON b.doc_id = a.doc_id AND b.tok = bg.w2 GROUP BY 1)
SELECT s.doc_id, coalesce(h.hits, 0) AS hits, round(coalesce(m.ways, 0) * 1.0 / s.n, 6) AS expected FROM s LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)""")
def pair_null_expectation(spark, sf):
    """The mean of the same null in closed form: of two given words in n, each stands right before the other in one n-th of all orders."""
    ship_package(spark)
    docs = token_docs(spark, sf).where(F.size("toks") > 1).select("doc_id", "toks")
    x = nulls.pair_expectation(docs, reference_bigrams(spark, sf))
    of = lambda c: F.when(F.col("doc_id").isNull(), 0).otherwise(F.col(c))
    return x.select("doc_id", of("hits").alias("hits"), r6(of("ways") / F.col("n")).alias("expected"))


@query(f"""WITH {TOKENS}, {DICT}, t AS (SELECT tok, count(*) AS c FROM tokens GROUP BY 1), n AS (SELECT tok, c, translate(tok, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') AS fake FROM t),
k AS (SELECT DISTINCT {skeleton('word')} AS skel, length(word) AS len FROM dict), s AS (SELECT DISTINCT skel FROM k), m AS (SELECT c, CASE WHEN {skeleton('tok')} IN (SELECT skel FROM s WHERE skel <> '') THEN 1 ELSE 0 END AS r, CASE WHEN {skeleton('fake')} IN (SELECT skel FROM s WHERE skel <> '') THEN 1 ELSE 0 END AS f FROM n)
SELECT round(sum(c * r) * 1.0 / sum(c), 6) AS real_rate, round(sum(c * f) * 1.0 / sum(c), 6) AS null_rate, round(sum(c * r) * 1.0 / sum(c * f), 6) AS selectivity FROM m""")
def selectivity(spark, sf):
    """How much oftener real words hit the dictionary's skeletons than the same words under a shifted alphabet."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    t = stats.word_counts(token_docs(spark, sf)).select("c", ft.skeleton(F.col("tok")).alias("a"), ft.skeleton(F.translate("tok", abc, abc[13:] + abc[:13])).alias("b"))
    s = dictionary(spark, sf).select(ft.skeleton(F.col("word")).alias("skel")).where("skel <> ''").distinct()
    x = t.join(s.select(F.col("skel").alias("a"), F.lit(1).alias("ra")), "a", "left").join(s.select(F.col("skel").alias("b"), F.lit(1).alias("rb")), "b", "left")
    hit = lambda c: F.sum(F.when(F.col(c) == 1, F.col("c")).otherwise(0))
    return x.agg(r6(hit("ra") / F.sum("c")).alias("real_rate"), r6(hit("rb") / F.sum("c")).alias("null_rate"), r6(F.try_divide(hit("ra"), hit("rb"))).alias("selectivity"))


@query(f"""WITH {DICT}, p AS (SELECT item_id, tok AS w1, lead(tok) OVER (PARTITION BY item_id ORDER BY pos) AS w2 FROM btok), u AS (SELECT DISTINCT w1, w2, item_id FROM p WHERE w2 IS NOT NULL), o AS (SELECT w1, w2, count(*) AS items, min(item_id) AS only_item FROM u GROUP BY 1, 2)
SELECT u.item_id, count(*) AS pairs, count(*) FILTER (o.items = 1) AS lost, round(count(*) FILTER (o.items = 1) * 1.0 / count(*), 6) AS share FROM u JOIN o ON o.w1 = u.w1 AND o.w2 = u.w2 GROUP BY 1""")
def leave_one_out_depletion(spark, sf):
    """Pairs of the reference that vanish with one item: counted once for all items, not by a run for each."""
    u = table(spark, sf, "benchmark").select("item_id", F.explode(neighbours(token_array(F.col("text")))).alias("b")).select("item_id", "b.*").distinct()
    o = u.withColumn("items", F.count(F.lit(1)).over(Window.partitionBy("w1", "w2")))
    return o.groupBy("item_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("items") == 1).alias("lost"), r6(F.count_if(F.col("items") == 1) / F.count(F.lit(1))).alias("share"))


@query(f"""WITH {TOKENS}, {DICT}, g AS (SELECT a AS min_freq, b AS max_len FROM (SELECT unnest([1, 2, 5, 10]) AS a), (SELECT unnest([4, 6, 8, 12]) AS b)), t AS (SELECT tok, count(*) AS c FROM tokens GROUP BY 1),
x AS (SELECT min_freq, max_len, sum(t.c) AS hits FROM g JOIN dict ON freq >= min_freq AND length(word) <= max_len JOIN t ON t.tok = word GROUP BY 1, 2)
SELECT min_freq, max_len, CAST(hits AS BIGINT) AS hits, row_number() OVER (ORDER BY hits DESC, min_freq, max_len) AS rank FROM x WHERE hits * 1.0 / (SELECT sum(c) FROM t) BETWEEN 0.05 AND 0.95""")
def parameter_grid(spark, sf):
    """A grid of parameters in one plan: the words are joined once, the grid is a few rows."""
    t = stats.word_counts(token_docs(spark, sf))
    total = t.agg(F.sum("c").alias("t"))
    known = t.join(dictionary(spark, sf).withColumnRenamed("word", "tok"), "tok").groupBy("freq", F.length("tok").alias("len")).agg(F.sum("c").alias("c"))
    a, b = [1, 2, 5, 10], [4, 6, 8, 12]
    cells = F.array(*(F.struct(F.lit(i).alias("min_freq"), F.lit(j).alias("max_len")) for i in a for j in b))
    x = known.withColumn("g", F.explode(cells)).where((F.col("freq") >= F.col("g.min_freq")) & (F.col("len") <= F.col("g.max_len")))
    x = x.groupBy("g.min_freq", "g.max_len").agg(F.sum("c").alias("hits")).join(F.broadcast(total)).where((F.col("hits") / F.col("t")).between(0.05, 0.95))
    w = Window.orderBy(F.desc("hits"), "min_freq", "max_len")
    return x.select("min_freq", "max_len", "hits", F.row_number().over(w).cast("long").alias("rank"))


@query(f"""WITH {TOKENS}, c AS (SELECT lang, tok, count(*) AS n FROM tokens GROUP BY 1, 2), m AS (SELECT lang, tok, n, first_value(tok) OVER (PARTITION BY lang, {skeleton('tok')}, length(tok) ORDER BY n DESC, tok) AS canon FROM c WHERE {skeleton('tok')} <> ''),
b AS (SELECT lang, canon, sum(n) AS n FROM m GROUP BY 1, 2), x AS (SELECT lang, count(*) AS before_, sum(n) AS t FROM m GROUP BY 1), y AS (SELECT lang, count(*) AS after_ FROM b GROUP BY 1)
SELECT lang, before_ AS types_before, after_ AS types_after, round(before_ * 1.0 / t, 6) AS ttr_before, round(after_ * 1.0 / t, 6) AS ttr_after FROM x JOIN y USING (lang)""")
def merge_variants(spark, sf):
    """Words of one skeleton and length become the most frequent of them."""
    c = stats.word_counts(token_docs(spark, sf), "lang").withColumn("skel", ft.skeleton(F.col("tok"))).where("skel <> ''")
    g = c.groupBy("lang", "skel", F.length("tok").alias("len")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"))
    x = g.groupBy("lang").agg(F.sum("k").alias("types_before"), F.count(F.lit(1)).alias("types_after"), F.sum("n").alias("t"))
    return x.select("lang", "types_before", "types_after", r6(F.col("types_before") / F.col("t")).alias("ttr_before"), r6(F.col("types_after") / F.col("t")).alias("ttr_after"))


@query(f"""WITH {TOKENS}, t AS (SELECT tok, count(*) >= 2 AS f FROM tokens GROUP BY 1), x AS (SELECT k.doc_id, k.pos, k.tok, t.f FROM tokens k JOIN t USING (tok)),
f AS (SELECT doc_id, tok, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM x WHERE f), s AS (SELECT x.doc_id, x.pos, (SELECT count(*) FROM f WHERE f.doc_id = x.doc_id AND f.pos < x.pos) AS b FROM x WHERE NOT f)
SELECT f.tok, count(*) AS c FROM s JOIN f ON f.doc_id = s.doc_id AND f.r BETWEEN s.b - 2 AND s.b + 3 GROUP BY 1""")
def singleton_contexts(spark, sf):
    """The three frequent words on each side of words that occur once."""
    docs = token_docs(spark, sf)
    t = stats.word_counts(docs).select("tok", (F.col("c") >= 2).alias("f"))
    x = explode_tokens(docs).select("doc_id", "pos", "tok").join(t, "tok")
    r = x.withColumn("b", F.sum(F.col("f").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    near = r.where("not f").select("doc_id", F.explode(F.sequence(F.col("b") - 2, F.col("b") + 3)).alias("b"))
    return near.join(r.where("f").select("doc_id", "b", "tok"), ["doc_id", "b"]).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
