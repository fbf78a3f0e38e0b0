"""Queries of sequence statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.operators import rolling, stats
from stratalex.plans.registry import query
from stratalex.plans.sqltext import CHARS, DICT, PAIRS, TOKENS
from stratalex.session import Tables, drop_path, materialize, ship_package
from stratalex.sources.tables import explode_tokens, fixed, neighbours, table, token_docs, tokens

r6 = lambda c: F.round(c, 6)


@query(f"""WITH {TOKENS}, {CHARS}, n AS (SELECT lang, c1 AS ch, count(*) AS c FROM nexts GROUP BY 1, 2)
SELECT lang, ch, c, round(c * 1.0 / sum(c) OVER (PARTITION BY lang), 6) AS p FROM n""")
def char_frequency(spark, sf):
    n = stats.char_grams(token_docs(spark, sf), "lang").groupBy("lang", "ch").agg(F.sum("n").alias("c"))
    return n.select("lang", "ch", "c", r6(F.col("c") / F.sum("c").over(Window.partitionBy("lang"))).alias("p"))


_H = """h1 AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, c1, count(*) AS n FROM nexts GROUP BY 1, 2) GROUP BY 1),
j2 AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, c1, c2, count(*) AS n FROM nexts WHERE c2 IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
x2 AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, c1, count(*) AS n FROM nexts WHERE c2 IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
j3 AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, c1, c2, c3, count(*) AS n FROM nexts WHERE c3 IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1),
x3 AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, c1, c2, count(*) AS n FROM nexts WHERE c3 IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
ent AS (SELECT h1.lang, h1.h AS h1, j2.h - x2.h AS h2, j3.h - x3.h AS h3 FROM h1 JOIN j2 USING (lang) JOIN x2 USING (lang) JOIN j3 USING (lang) JOIN x3 USING (lang))"""


@query(f"WITH {TOKENS}, {CHARS}, {_H} SELECT lang, round(h1, 6) AS h1, round(h2, 6) AS h2, round(h3, 6) AS h3 FROM ent")
def char_entropy(spark, sf):
    h = stats.char_entropies(stats.char_grams(token_docs(spark, sf), "lang"), "lang")
    return h.select("lang", *(r6(F.col(c)).alias(c) for c in ("h1", "h2", "h3")))


@query(f"""WITH {TOKENS}, {PAIRS}, n AS (SELECT lang, w1, w2, count(*) AS n FROM pairs WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, CAST(sum(n) AS BIGINT) AS pairs FROM n GROUP BY 1),
x AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, w1, sum(n) AS n FROM n GROUP BY 1, 2) GROUP BY 1)
SELECT lang, round(j.h - x.h, 6) AS h_word, pairs FROM j JOIN x USING (lang)""")
def word_entropy(spark, sf):
    h = stats.word_conditional_entropy(stats.word_pairs(token_docs(spark, sf), "lang"), "lang")
    return h.select("lang", r6(F.col("h")).alias("h_word"), "pairs")


@query(f"WITH {TOKENS} SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2")
def word_frequency(spark, sf):
    return stats.word_counts(token_docs(spark, sf), "lang")


_Z = """cnt AS (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2),
rk AS (SELECT lang, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, tok) AS rank FROM cnt),
zipf AS (SELECT lang, -regr_slope(ln(c + 1e-10), ln(rank)) AS exponent, regr_r2(ln(c + 1e-10), ln(rank)) AS r2,
  count(*) AS types, CAST(sum(c) AS BIGINT) AS total, count(*) * 1.0 / sum(c) AS ttr FROM rk GROUP BY 1)"""


@query(f"WITH {TOKENS}, {_Z} SELECT lang, round(exponent, 6) AS exponent, round(r2, 6) AS r2, types, total, round(ttr, 6) AS ttr FROM zipf")
def zipf_by_lang(spark, sf):
    z = stats.zipf(stats.word_counts(token_docs(spark, sf), "lang"), "lang")
    return z.select("lang", r6(F.col("exponent")).alias("exponent"), r6(F.col("r2")).alias("r2"), "types", "total", r6(F.col("ttr")).alias("ttr"))


_PROFILE = f"""WITH {TOKENS}, {CHARS}, {_H}, {_Z},
len AS (SELECT lang, avg(length(tok)) AS avg_len, stddev_pop(length(tok)) AS std_len FROM tokens GROUP BY 1),
prof AS (SELECT lang, h1, h2, h3, exponent, ttr, avg_len, std_len FROM ent JOIN zipf USING (lang) JOIN len USING (lang))"""


def profile(spark, sf):
    """One row of scalars for each language; every part is an aggregate of small tables of counts."""
    docs = token_docs(spark, sf)
    counts = stats.word_counts(docs, "lang")
    h = stats.char_entropies(stats.char_grams(docs, "lang"), "lang")
    z = stats.zipf(counts, "lang").select("lang", "exponent", "ttr")
    by_len = counts.groupBy("lang", F.length("tok").alias("len")).agg(F.sum("c").alias("c"))
    mean = F.sum(F.col("len") * F.col("c")) / F.sum("c")
    square = F.sum(F.col("len") * F.col("len") * F.col("c")) / F.sum("c")
    lens = by_len.groupBy("lang").agg(mean.alias("avg_len"), F.sqrt(square - mean * mean).alias("std_len"))
    return h.join(z, "lang").join(lens, "lang")


@query(_PROFILE + " SELECT lang, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("h1", "h2", "h3", "exponent", "ttr", "avg_len", "std_len")) + " FROM prof")
def text_profile(spark, sf):
    return profile(spark, sf).select("lang", *(r6(F.col(c)).alias(c) for c in ("h1", "h2", "h3", "exponent", "ttr", "avg_len", "std_len")))


# weights of the composite distance
_W = {"h1": 1, "h2": 3, "h3": 3, "exponent": 2, "avg_len": 1, "ttr": 1.5}


@query(_PROFILE + " SELECT a.lang AS a, b.lang AS b, round(sqrt(" + " + ".join(f"{w} * pow(a.{c} - b.{c}, 2)" for c, w in _W.items())
       + "), 6) AS distance FROM prof a JOIN prof b ON a.lang < b.lang")
def profile_distance_pairs(spark, sf):
    p = profile(spark, sf)
    a, b = p.select(F.struct("*").alias("x")), p.select(F.struct("*").alias("y"))
    # a row for each language: the pairs are few
    both = a.join(b, F.col("x.lang") < F.col("y.lang"))
    square = sum((w * F.pow(F.col(f"x.{c}") - F.col(f"y.{c}"), 2) for c, w in _W.items()), F.lit(0.0))
    return both.select(F.col("x.lang").alias("a"), F.col("y.lang").alias("b"), r6(F.sqrt(square)).alias("distance"))


@query(_PROFILE + ", t AS (SELECT * FROM prof WHERE lang = 'en') SELECT p.lang, round(sqrt(3 * pow(p.h2 - t.h2, 2) + 1.5 * pow(p.ttr - t.ttr, 2) + 2 * pow(p.exponent - t.exponent, 2)), 6) AS distance, "
       "CAST(row_number() OVER (ORDER BY round(sqrt(3 * pow(p.h2 - t.h2, 2) + 1.5 * pow(p.ttr - t.ttr, 2) + 2 * pow(p.exponent - t.exponent, 2)), 6), p.lang) AS BIGINT) AS rank FROM prof p, t WHERE p.lang <> 'en'")  # fmt: skip
def language_ranking(spark, sf):
    p = profile(spark, sf)
    t = p.where("lang = 'en'").select(F.col("h2").alias("a"), F.col("ttr").alias("b"), F.col("exponent").alias("z"))
    d = r6(F.sqrt(3 * F.pow(F.col("h2") - F.col("a"), 2) + 1.5 * F.pow(F.col("ttr") - F.col("b"), 2) + 2 * F.pow(F.col("exponent") - F.col("z"), 2)))
    out = p.where("lang <> 'en'").join(F.broadcast(t)).select("lang", d.alias("distance"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("distance", "lang")).cast("long"))


_CT = "ct AS (SELECT lang, c1, c2, count(*) AS c, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang, c1) AS p FROM nexts WHERE c2 IS NOT NULL GROUP BY 1, 2, 3)"


def char_transitions(spark, sf):
    n = stats.char_grams(token_docs(spark, sf), "lang").where("p1 is not null").groupBy("lang", F.col("p1").alias("c1"), F.col("ch").alias("c2")).agg(F.sum("n").alias("c"))
    return n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("lang", "c1")))


@query(f"WITH {TOKENS}, {CHARS}, {_CT} SELECT lang, c1, c2, c, round(p, 6) AS p FROM ct")
def char_transition(spark, sf):
    return char_transitions(spark, sf).select("lang", "c1", "c2", "c", r6(F.col("p")).alias("p"))


@query(f"""WITH {TOKENS}, {CHARS}, {_CT}, al AS (SELECT DISTINCT lang, c1 AS ch FROM ct),
prs AS (SELECT x.lang AS a, y.lang AS b FROM (SELECT DISTINCT lang FROM ct) x JOIN (SELECT DISTINCT lang FROM ct) y ON x.lang < y.lang),
com AS (SELECT prs.a, prs.b, x.ch FROM prs JOIN al x ON x.lang = prs.a JOIN al y ON y.lang = prs.b AND y.ch = x.ch),
cell AS (SELECT u.a, u.b, coalesce(p.p, 0) + 1e-10 AS p, coalesce(q.p, 0) + 1e-10 AS q FROM com u JOIN com v ON u.a = v.a AND u.b = v.b
  LEFT JOIN ct p ON p.lang = u.a AND p.c1 = u.ch AND p.c2 = v.ch LEFT JOIN ct q ON q.lang = u.b AND q.c1 = u.ch AND q.c2 = v.ch),
nrm AS (SELECT a, b, p / sum(p) OVER (PARTITION BY a, b) AS p, q / sum(q) OVER (PARTITION BY a, b) AS q FROM cell)
SELECT a, b, round(sum(0.5 * p * log2(2 * p / (p + q)) + 0.5 * q * log2(2 * q / (p + q))), 6) AS jsd FROM nrm GROUP BY 1, 2""")
def jsd_language_pairs(spark, sf):
    t = char_transitions(spark, sf).select("lang", "c1", "c2", "p")
    rows = t.groupBy("lang").agg(F.collect_set("c1").alias("al"), F.map_from_entries(F.collect_list(F.struct(F.concat("c1", "c2"), "p"))).alias("m"))
    left = rows.select(F.col("lang").alias("a"), F.col("al").alias("al_a"), F.col("m").alias("ma"))
    right = rows.select(F.col("lang").alias("b"), F.col("al").alias("al_b"), F.col("m").alias("mb"))
    both = left.join(right, F.col("a") < F.col("b")).withColumn("al", F.array_intersect("al_a", "al_b"))
    both = both.select("a", "b", "ma", "mb", "al", F.explode("al").alias("u")).select("a", "b", "ma", "mb", "u", F.explode("al").alias("v"))
    key = F.concat("u", "v")
    cell = both.select(
        "a", "b",
        (F.coalesce(F.try_element_at("ma", key), F.lit(0.0)) + 1e-10).alias("p"),
        (F.coalesce(F.try_element_at("mb", key), F.lit(0.0)) + 1e-10).alias("q"),
    )
    w = Window.partitionBy("a", "b")
    n = cell.select("a", "b", (F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q"))
    half = lambda x: 0.5 * F.col(x) * F.log2(2 * F.col(x) / (F.col("p") + F.col("q")))
    return n.groupBy("a", "b").agg(r6(F.sum(half("p") + half("q"))).alias("jsd"))


_TOP50 = "top AS (SELECT tok FROM (SELECT tok, count(*) AS c FROM tokens GROUP BY 1) ORDER BY c DESC, tok LIMIT 50)"


@query(f"""WITH {TOKENS}, {PAIRS}, {_TOP50}, n AS (SELECT w1, w2, count(*) AS c FROM pairs WHERE w1 IN (SELECT tok FROM top) AND w2 IN (SELECT tok FROM top) GROUP BY 1, 2)
SELECT w1, w2, c, round(c * 1.0 / sum(c) OVER (PARTITION BY w1), 6) AS p FROM n""")
def word_transition_topn(spark, sf):
    docs = token_docs(spark, sf)
    pairs = stats.word_pairs(docs)
    best = stats.top(stats.word_counts(docs), 50).select("tok")
    kept = pairs.join(F.broadcast(best.withColumnRenamed("tok", "w1")), "w1", "left_semi").join(F.broadcast(best.withColumnRenamed("tok", "w2")), "w2", "left_semi")
    return kept.select("w1", "w2", F.col("n").alias("c"), r6(F.col("n") / F.sum("n").over(Window.partitionBy("w1"))).alias("p"))


@query(f"""WITH {TOKENS}, {PAIRS}, {_TOP50}, tier AS (SELECT tok FROM tokens GROUP BY 1 HAVING count(*) >= 2),
t1 AS (SELECT doc_id, pos, tok FROM tokens WHERE tok IN (SELECT tok FROM tier)),
br AS (SELECT tok AS w1, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM t1),
n AS (SELECT w1, w2, count(*) AS c FROM br WHERE w1 IN (SELECT tok FROM top) AND w2 IN (SELECT tok FROM top) GROUP BY 1, 2)
SELECT w1, w2, c, round(c * 1.0 / sum(c) OVER (PARTITION BY w1), 6) AS p FROM n""")
def bridged_bigrams(spark, sf):
    """Neighbours among words that occur twice or more, skipping those that occur once."""
    docs = token_docs(spark, sf)
    counts = stats.word_counts(docs)
    frequent = counts.where("c >= 2").select("tok")
    kept = explode_tokens(docs).select("doc_id", "pos", "tok").join(frequent, "tok", "left_semi")
    seq = kept.withColumn("w2", F.lead("tok").over(Window.partitionBy("doc_id").orderBy("pos")))
    best = F.broadcast(stats.top(counts, 50).select("tok"))
    n = seq.join(best, "tok", "left_semi").join(best.withColumnRenamed("tok", "w2"), "w2", "left_semi")
    n = n.groupBy(F.col("tok").alias("w1"), "w2").agg(F.count(F.lit(1)).alias("c"))
    return n.withColumn("p", r6(F.col("c") / F.sum("c").over(Window.partitionBy("w1"))))


_POS = """types AS (SELECT tok, count(*) AS c FROM tokens GROUP BY 1),
pc AS (SELECT c, length(tok) AS len, unnest(string_split(tok, '')) AS ch, unnest(range(length(tok))) AS i FROM types),
gp AS (SELECT ch, CAST(coalesce(sum(c) FILTER (len > 1 AND i = 0), 0) AS BIGINT) AS initial, CAST(coalesce(sum(c) FILTER (len > 1 AND i > 0 AND i < len - 1), 0) AS BIGINT) AS medial,
  CAST(coalesce(sum(c) FILTER (len > 1 AND i = len - 1), 0) AS BIGINT) AS final, CAST(coalesce(sum(c) FILTER (len = 1), 0) AS BIGINT) AS singleton FROM pc GROUP BY 1)"""


@query(f"WITH {TOKENS}, {_POS} SELECT ch, initial, medial, final, singleton FROM gp")
def glyph_positions(spark, sf):
    return stats.positions(stats.word_counts(token_docs(spark, sf)))


@query(f"""WITH {TOKENS}, {_POS}, s AS (SELECT ch, initial * 1.0 / (initial + medial + final + singleton) AS a, medial * 1.0 / (initial + medial + final + singleton) AS b,
  final * 1.0 / (initial + medial + final + singleton) AS c, singleton * 1.0 / (initial + medial + final + singleton) AS d FROM gp),
o AS (SELECT ch, a, b, c, list_reverse_sort([a, b, c, d]) AS l FROM s)
SELECT ch, CASE WHEN a >= 0.65 THEN 'PREFIX' WHEN c >= 0.65 THEN 'SUFFIX' WHEN b >= 0.65 THEN 'MEDIAL' ELSE 'ANY' END AS class, round(l[1] - l[2], 6) AS confidence FROM o""")
def glyph_classes(spark, sf):
    return stats.glyph_classes(stats.positions(stats.word_counts(token_docs(spark, sf)))).withColumn("confidence", r6(F.col("confidence")))


@query(f"""WITH {TOKENS}, pc AS (SELECT lang, unnest(string_split(tok, '')) AS ch, unnest(range(length(tok))) AS pos FROM tokens),
n AS (SELECT lang, pos, ch, count(*) AS n FROM pc WHERE pos < 10 GROUP BY 1, 2, 3)
SELECT lang, pos, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS h FROM n GROUP BY 1, 2""")
def positional_entropy(spark, sf):
    counts = stats.word_counts(token_docs(spark, sf), "lang")
    chars = counts.select("lang", "c", F.posexplode(F.slice(F.filter(F.split("tok", ""), lambda x: x != ""), 1, 10)).alias("pos", "ch"))
    n = chars.groupBy("lang", "pos", "ch").agg(F.sum("c").alias("n"))
    return n.groupBy("lang", F.col("pos").cast("long").alias("pos")).agg(F.round(stats.bits("n"), 4).alias("h"))


@query(f"WITH {TOKENS} SELECT lang, CAST(length(tok) AS BIGINT) AS len, count(*) AS c FROM tokens GROUP BY 1, 2")
def length_histogram(spark, sf):
    return stats.word_counts(token_docs(spark, sf), "lang").groupBy("lang", F.length("tok").cast("long").alias("len")).agg(F.sum("c").alias("c"))


@query(f"WITH {TOKENS} SELECT lang, round(avg(length(tok)), 6) AS mean, round(stddev_pop(length(tok)), 6) AS std, round(quantile_cont(length(tok), 0.5), 6) AS median FROM tokens GROUP BY 1")
def length_stats(spark, sf):
    # lengths are few: the exact median comes from weights, not from a sort of all tokens
    n = stats.word_counts(token_docs(spark, sf), "lang").groupBy("lang", F.length("tok").alias("len")).agg(F.sum("c").alias("c"))
    mean = F.sum(F.col("len") * F.col("c")) / F.sum("c")
    square = F.sum(F.col("len") * F.col("len") * F.col("c")) / F.sum("c")
    return n.groupBy("lang").agg(r6(mean).alias("mean"), r6(F.sqrt(square - mean * mean)).alias("std"), r6(F.percentile("len", F.lit(0.5), F.col("c"))).alias("median"))


_Q = "q AS (SELECT doc_id, lang, tok, pos, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens)"


@query(f"""WITH {TOKENS}, {_Q}, z AS (SELECT lang, tok, CASE WHEN pos < greatest(n // 4, 1) THEN 'first' WHEN pos >= n - greatest(n // 4, 1) THEN 'last' ELSE 'middle' END AS part FROM q WHERE n >= 4),
c AS (SELECT lang, part, tok, count(*) AS n FROM z GROUP BY 1, 2, 3)
SELECT lang, part, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h, round(count(*) * 1.0 / sum(n), 6) AS ttr, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1, 2""")
def quartile_entropy(spark, sf):
    """First and last quarter (of n // 4 words, one at least) against the middle."""
    docs = token_docs(spark, sf).withColumn("n", F.size("toks")).where("n >= 4")
    q = F.greatest(F.floor(F.col("n") / 4), F.lit(1))
    rows = docs.select("lang", "n", q.alias("q"), F.posexplode("toks").alias("pos", "tok"))
    part = F.when(F.col("pos") < F.col("q"), "first").when(F.col("pos") >= F.col("n") - F.col("q"), "last").otherwise("middle")
    c = rows.groupBy("lang", part.alias("part"), "tok").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang", "part").agg(r6(stats.bits("n")).alias("h"), r6(F.count(F.lit(1)) / F.sum("n")).alias("ttr"), F.sum("n").alias("total"))


_QTR = f"""WITH {TOKENS}, {_Q}, z AS (SELECT lang, tok, least(pos // (n // 4), 3) + 1 AS quarter FROM q WHERE n >= 12),
c AS (SELECT lang, quarter, tok, count(*) AS n FROM z GROUP BY 1, 2, 3),
h AS (SELECT lang, quarter, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY 1, 2)"""


def _quarters(spark, sf):
    docs = token_docs(spark, sf).withColumn("n", F.size("toks")).where("n >= 12")
    rows = docs.select("lang", "n", F.posexplode("toks").alias("pos", "tok"))
    quarter = (F.least(F.floor(F.col("pos") / F.floor(F.col("n") / 4)), F.lit(3)) + 1).cast("long")
    c = rows.groupBy("lang", quarter.alias("quarter"), "tok").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("lang", "quarter").agg(stats.bits("n").alias("h"))


@query(_QTR + " SELECT lang, CAST(quarter AS BIGINT) AS quarter, round(h, 6) AS h FROM h")
def paragraph_quarters(spark, sf):
    """Four quarters of n // 4 words, the rest in the last."""
    return _quarters(spark, sf).withColumn("h", r6(F.col("h")))


@query(_QTR + """, p AS (SELECT lang, max(h) FILTER (quarter = 1) AS q1, max(h) FILTER (quarter = 2) AS q2, max(h) FILTER (quarter = 3) AS q3, max(h) FILTER (quarter = 4) AS q4 FROM h GROUP BY 1)
SELECT lang, round((q1 + q4) / 2 - (q2 + q3) / 2, 6) AS depth, q2 < q1 AND q3 < q4 AS is_u, CASE least(q1, q2, q3, q4) WHEN q1 THEN 1 WHEN q2 THEN 2 WHEN q3 THEN 3 ELSE 4 END AS anchor FROM p""")  # fmt: skip
def u_curve(spark, sf):
    p = _quarters(spark, sf).groupBy("lang").pivot("quarter", [1, 2, 3, 4]).agg(F.max("h"))
    q = [F.col(str(i)) for i in (1, 2, 3, 4)]
    low = F.least(*q)
    anchor = F.when(low == q[0], 1).when(low == q[1], 2).when(low == q[2], 3).otherwise(4)
    return p.select("lang", r6((q[0] + q[3]) / 2 - (q[1] + q[2]) / 2).alias("depth"), ((q[1] < q[0]) & (q[2] < q[3])).alias("is_u"), anchor.alias("anchor"))


@query(f"""WITH {TOKENS}, s AS (SELECT doc_id, toks, unnest(range(0, len(toks) - 15, 5)) AS st FROM d WHERE len(toks) > 15),
w AS (SELECT doc_id, st, unnest(toks[st + 1:st + 15]) AS tok FROM s), c AS (SELECT doc_id, st, tok, count(*) AS n FROM w GROUP BY 1, 2, 3),
h AS (SELECT doc_id, st, log2(15) - sum(n * log2(n)) / 15 AS h FROM c GROUP BY 1, 2)
SELECT doc_id, count(*) AS windows, round(avg(h), 6) AS mean_h, round(max(h) - min(h), 6) AS spread FROM h GROUP BY 1""")
def rolling_entropy(spark, sf):
    """Entropy of 15 words every five words; all within the row, so no window is shuffled."""
    ship_package(spark)
    docs = token_docs(spark, sf).where(F.size("toks") > 15).select("doc_id", "toks")
    hs = rolling.window_entropies(docs, width=15, step=5)
    return hs.select("doc_id", "windows", r6(F.col("mean_h")).alias("mean_h"), r6(F.col("spread")).alias("spread"))


@query(f"""WITH {TOKENS}, e AS (SELECT 'head' AS side, unnest(toks[1:10]) AS tok FROM d UNION ALL SELECT 'tail', unnest(toks[greatest(len(toks) - 9, 1):len(toks)]) FROM d)
SELECT side, tok, count(*) AS c FROM e GROUP BY 1, 2""")
def boundary_tokens(spark, sf):
    docs = token_docs(spark, sf).where(F.size("toks") > 0)
    n = F.least(F.size("toks"), F.lit(10))
    sides = F.array(F.struct(F.lit("head").alias("side"), F.slice("toks", F.lit(1), n).alias("t")), F.struct(F.lit("tail").alias("side"), F.slice("toks", -n, n).alias("t")))
    rows = docs.select(F.explode(sides).alias("s")).select("s.side", F.explode("s.t").alias("tok"))
    return rows.groupBy("side", "tok").agg(F.count(F.lit(1)).alias("c"))


@query("""WITH x AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, count(*) FILTER (prev IS NOT NULL AND prev <> role) AS changes, count(*) AS turns FROM x GROUP BY 1""")
def role_change_points(spark, sf):
    x = table(spark, sf, "conversations").withColumn("prev", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return x.groupBy("conv_id").agg(F.count_if(F.col("prev") != F.col("role")).alias("changes"), F.count(F.lit(1)).alias("turns"))


@query("""WITH x AS (SELECT role AS r1, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations), n AS (SELECT r1, r2, count(*) AS c FROM x WHERE r2 IS NOT NULL GROUP BY 1, 2)
SELECT r1, r2, c, round(c * 1.0 / sum(c) OVER (PARTITION BY r1), 6) AS p FROM n""")
def role_transitions(spark, sf):
    x = table(spark, sf, "conversations").withColumn("r2", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    n = x.where("r2 is not null").groupBy(F.col("role").alias("r1"), "r2").agg(F.count(F.lit(1)).alias("c"))
    return n.withColumn("p", r6(F.col("c") / F.sum("c").over(Window.partitionBy("r1"))))


#: Ids of one range, within which neighbours are found by a sort.
RANGE = 4096
_DOCH = """dc AS (SELECT doc_id, source, unnest(string_split(array_to_string(toks, ''), '')) AS ch, unnest(range(length(array_to_string(toks, '')))) AS i FROM d WHERE len(toks) > 0),
nx AS (SELECT doc_id, source, ch AS c1, lead(ch) OVER (PARTITION BY doc_id ORDER BY i) AS c2 FROM dc),
a AS (SELECT doc_id, source, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h1 FROM (SELECT doc_id, source, c1, count(*) AS n FROM nx GROUP BY 1, 2, 3) GROUP BY 1, 2),
j AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT doc_id, c1, c2, count(*) AS n FROM nx WHERE c2 IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
x AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT doc_id, c1, count(*) AS n FROM nx WHERE c2 IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
dh AS (SELECT a.doc_id, a.source, a.h1, coalesce(j.h - x.h, 0) AS h2 FROM a LEFT JOIN j USING (doc_id) LEFT JOIN x USING (doc_id))"""


def doc_entropies(spark, sf, *keys: str):
    """(doc_id, keys, h1, h2): letter entropies of each document; a written table, as most queries read it several times."""
    ship_package(spark)
    docs = token_docs(spark, sf).select("doc_id", *keys, F.array_join("toks", "").alias("letters")).where("letters <> ''")
    return materialize(stats.letter_entropies(docs, "doc_id", *keys), "entropies")[0]


@query(f"""WITH {TOKENS}, {_DOCH}, l AS (SELECT source, abs(h1 - lag(h1) OVER w) AS d1, abs(h2 - lag(h2) OVER w) AS d2 FROM dh WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, round(0.4 * avg(d1) + 0.6 * avg(d2), 6) AS drift, count(d1) AS steps FROM l GROUP BY 1""")
def adjacent_doc_delta(spark, sf):
    """Mean change of entropy from one document of a source to its next.

    Neighbours are found within ranges of ids; only the first and the last
    document of each range meet those of the ranges beside it, so a source of a
    third of all documents is not one sort.
    """
    h = doc_entropies(spark, sf, "source").select("source", "doc_id", F.floor(F.col("doc_id") / RANGE).alias("block"), F.struct("h1", "h2").alias("h"))
    own = Window.partitionBy("source", "block").orderBy("doc_id")
    inner = h.select("source", F.lag("h").over(own).alias("a"), F.col("h").alias("b"))
    ends = h.groupBy("source", "block").agg(F.min(F.struct("doc_id", "h")).alias("head"), F.max(F.struct("doc_id", "h")).alias("tail"))
    edge = ends.select("source", F.lag("tail.h").over(Window.partitionBy("source").orderBy("block")).alias("a"), F.col("head.h").alias("b"))
    l = inner.unionByName(edge).where("a is not null").select("source", F.abs(F.col("b.h1") - F.col("a.h1")).alias("d1"), F.abs(F.col("b.h2") - F.col("a.h2")).alias("d2"))
    steps = l.groupBy("source").agg((0.4 * F.avg("d1") + 0.6 * F.avg("d2")).alias("drift"), F.count("d1").alias("steps"))
    all_ = h.select(F.col("source").alias("own")).distinct()
    x = all_.join(steps, F.col("own").eqNullSafe(F.col("source")), "left")
    return x.select(F.col("own").alias("source"), r6(F.col("drift")).alias("drift"), F.coalesce("steps", F.lit(0)).alias("steps"))


@query(f"""WITH {TOKENS}, {_DOCH}, s AS (SELECT source, avg(h1) AS h1, avg(h2) AS h2 FROM dh GROUP BY 1)
SELECT round(corr(abs(a.h1 - b.h1), abs(a.h2 - b.h2)), 6) AS r, count(*) AS pairs FROM s a JOIN s b ON a.source < b.source""")
def distance_correlation(spark, sf):
    s = doc_entropies(spark, sf, "source").groupBy("source").agg(F.avg("h1").alias("h1"), F.avg("h2").alias("h2"))
    both = s.select(F.struct("*").alias("a")).join(s.select(F.struct("*").alias("b")), F.col("a.source") < F.col("b.source"))
    return both.agg(r6(F.corr(F.abs(F.col("a.h1") - F.col("b.h1")), F.abs(F.col("a.h2") - F.col("b.h2")))).alias("r"), F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH {TOKENS}, {_DOCH}, t AS (SELECT avg(h1) AS m FROM dh)
SELECT source, round(100.0 * count(*) FILTER (h1 <= m) / count(*), 6) AS percentile, count(*) AS docs FROM dh, t GROUP BY 1""")
def percentile_rank(spark, sf):
    h = doc_entropies(spark, sf, "source")
    m = h.agg(F.avg("h1").alias("m"))
    return h.join(F.broadcast(m)).groupBy("source").agg(r6(100.0 * F.count_if(F.col("h1") <= F.col("m")) / F.count(F.lit(1))).alias("percentile"), F.count(F.lit(1)).alias("docs"))


@query("""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT lang, list_filter(regexp_split_to_array(lower(line), '[^a-z]+'), lambda x: x <> '') AS t FROM l)
SELECT lang, t[1] AS tok, count(*) AS c FROM f WHERE len(t) > 0 GROUP BY 1, 2""")
def first_words(spark, sf):
    from stratalex.sources.tables import token_array

    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    t = lines.select("lang", token_array(F.col("line")).alias("t")).where(F.size("t") > 0)
    return t.groupBy("lang", F.get("t", F.lit(0)).alias("tok")).agg(F.count(F.lit(1)).alias("c"))


@query(f"""WITH {TOKENS}, {_Q} SELECT lang, count(*) AS c, round(avg(pos * 1.0 / greatest(n - 1, 1)), 6) AS mean_pos, count(*) FILTER (pos * 1.0 / greatest(n - 1, 1) < 0.25) AS first_quarter FROM q WHERE tok LIKE 'th%' OR tok = 't' GROUP BY 1""")
def normalized_position(spark, sf):
    rows = token_docs(spark, sf).select("lang", F.size("toks").alias("n"), F.posexplode("toks").alias("pos", "tok"))
    rows = rows.where(F.col("tok").startswith("th") | (F.col("tok") == "t"))
    at = F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), r6(F.avg(at)).alias("mean_pos"), F.count_if(at < 0.25).alias("first_quarter"))


@query(f"""WITH {TOKENS}, s AS (SELECT lang, source, count(*) FILTER (tok LIKE 'th%' OR tok = 't') AS hits, count(*) AS total FROM tokens GROUP BY 1, 2)
SELECT lang, source, hits, total, round(hits * 1.0 / total, 6) AS rate, round(hits * 1.0 / total / (sum(hits) OVER (PARTITION BY lang) / sum(total) OVER (PARTITION BY lang)), 6) AS ratio FROM s""")
def prefix_frequency_by_section(spark, sf):
    c = stats.word_counts(token_docs(spark, sf), "lang", "source")
    hit = F.col("tok").startswith("th") | (F.col("tok") == "t")
    s = c.groupBy("lang", "source").agg(F.sum(F.when(hit, F.col("c")).otherwise(0)).alias("hits"), F.sum("c").alias("total"))
    w = Window.partitionBy("lang")
    rate = F.col("hits") / F.col("total")
    return s.select("lang", "source", "hits", "total", r6(rate).alias("rate"), r6(F.try_divide(rate, F.sum("hits").over(w) / F.sum("total").over(w))).alias("ratio"))


@query(f"""WITH {TOKENS}, {DICT}, {PAIRS}, u AS (SELECT tok, count(*) AS c, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM tokens GROUP BY 1),
n AS (SELECT w1, w2, count(*) AS c, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY w1) AS p FROM pairs WHERE w2 IS NOT NULL GROUP BY 1, 2),
s AS (SELECT p.doc_id, -log2(greatest(CASE WHEN n.c >= 2 THEN n.p ELSE u.p END, 1e-6)) AS s FROM pairs p JOIN n ON n.w1 = p.w1 AND n.w2 = p.w2 JOIN u ON u.tok = p.w2),
t AS (SELECT quantile_cont(s, 0.75) + 1.5 * (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) AS thr, quantile_cont(s, 0.95) AS p95 FROM s)
SELECT doc_id, count(*) AS pairs, round(avg(s), 6) AS mean_s, count(*) FILTER (s > thr) AS beyond_iqr, count(*) FILTER (s > p95) AS beyond_p95 FROM s, t GROUP BY 1""")
def surprisal_anomalies(spark, sf):
    """Surprisal of each word given the one before; pairs seen once fall back on the word alone."""
    docs = token_docs(spark, sf)
    p, path = materialize(surprisals(docs), "surprisals")
    # surprisals take few values (one for each distinct pair): the exact quantiles come from weights
    q = p.groupBy("s").agg(F.sum("c").alias("n")).agg(F.percentile("s", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.95)), F.col("n")).alias("q")).first()["q"]
    thr, p95 = (F.lit(x) for x in (q[1] + 1.5 * (q[1] - q[0]), q[2])) if q else (F.lit(None), F.lit(None))
    flat = p.select("w1", "w2", "s", (F.col("s") > thr).cast("int").alias("far"), (F.col("s") > p95).cast("int").alias("high"))
    # each pair of a document meets its surprisal once; what it adds to the document is all that moves on
    x = docs.select("doc_id", F.explode(neighbours(F.col("toks"))).alias("b")).select("doc_id", "b.*").join(flat, ["w1", "w2"])
    g = x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), r6(F.sum("s") / F.count(F.lit(1))).alias("mean_s"), F.sum("far").alias("beyond_iqr"), F.sum("high").alias("beyond_p95"))
    done, _ = materialize(g, "anomalies")
    drop_path(spark, path)
    return done


def surprisals(docs):
    """(w1, w2, c, s): the pairs of neighbours with their number and surprisal. Words are counted by the pairs that they begin, with none after the last of a document."""
    tables = Tables(docs.sparkSession)
    i = F.sequence(F.lit(0), F.size("toks") - 1)
    pairs = docs.where(F.size("toks") > 0).select(F.explode(F.transform(i, lambda k: F.struct(F.get("toks", k).alias("w1"), F.get("toks", k + 1).alias("w2")))).alias("b"))
    n = tables.put(pairs.groupBy("b.w1", "b.w2").agg(F.count(F.lit(1)).alias("c")), "pairs")
    u = n.groupBy("w1").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("w2").isNotNull(), F.col("c"))).alias("t1"))
    words = tables.put(u, "words")
    u = words.join(F.broadcast(words.agg(F.sum("c").alias("t")))).select(F.col("w1").alias("w2"), (F.col("c") / F.col("t")).alias("pu"))
    p = n.where("w2 is not null").join(words.select("w1", "t1"), "w1").join(u, "w2")
    s = -F.log2(F.greatest(F.when(F.col("c") >= 2, F.col("c") / F.col("t1")).otherwise(F.col("pu")), F.lit(1e-6)))
    return p.select("w1", "w2", "c", s.alias("s"))


@query(f"""WITH {TOKENS}, m AS (SELECT doc_id, quantile_cont(length(tok), 0.5) AS m FROM tokens GROUP BY 1), x AS (SELECT t.doc_id, t.pos, length(t.tok) > m.m AS up FROM tokens t JOIN m USING (doc_id)),
y AS (SELECT doc_id, up, lag(up) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM x)
SELECT doc_id, 1 + count(*) FILTER (prev IS NOT NULL AND prev <> up) AS runs, count(*) FILTER (up) AS above FROM y GROUP BY 1""")
def runs_test(spark, sf):
    """Runs of word lengths above and not above the document's median, inside its row."""
    docs = token_docs(spark, sf).where(F.size("toks") > 0).select("doc_id", F.transform("toks", F.length).alias("l"))
    sorted_ = fixed(docs.select("doc_id", "l", F.array_sort("l").alias("s")), "doc_id", "l", "s")
    n = F.size("s")
    median = (F.get("s", F.floor((n - 1) / 2).cast("int")) + F.get("s", F.floor(n / 2).cast("int"))) / 2
    both = fixed(sorted_.select("doc_id", "l", median.alias("m")), "doc_id", "l", "m")
    up = fixed(both.select("doc_id", F.transform("l", lambda x: x > F.col("m")).alias("u")), "doc_id", "u")
    changes = F.size(F.filter(F.transform("u", lambda x, i: (i > 0) & (x != F.get("u", i - 1))), lambda x: x))
    return up.select("doc_id", (changes + 1).cast("long").alias("runs"), F.size(F.filter("u", lambda x: x)).cast("long").alias("above"))


@query(f"""WITH {TOKENS}, {DICT}, f AS (SELECT doc_id, pos, (tok IN (SELECT word FROM dict)) AS ok FROM tokens),
g AS (SELECT doc_id, ok, count(*) FILTER (ok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM f)
SELECT doc_id, count(*) AS total, count(*) FILTER (ok) AS known, count(*) FILTER (near >= 2) AS dense FROM g GROUP BY 1""")
def local_density(spark, sf):
    from stratalex.sources.tables import dictionary

    t = tokens(spark, sf).select("doc_id", "pos", "tok").join(dictionary(spark, sf).select(F.col("word").alias("tok"), F.lit(1).alias("hit")), "tok", "left")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-2, 2)
    g = t.withColumn("near", F.count("hit").over(w))
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("known"), F.count_if(F.col("near") >= 2).alias("dense"))


@query("""WITH t AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3, quantile_cont(n_chars, 0.95) AS p95, avg(n_chars) + 2 * stddev_pop(n_chars) AS two_sigma FROM documents GROUP BY 1)
SELECT d.lang, round(max(q1), 6) AS q1, round(max(q3), 6) AS q3, round(max(p95), 6) AS p95, round(max(two_sigma), 6) AS two_sigma, count(*) FILTER (n_chars > q3 + 1.5 * (q3 - q1)) AS beyond FROM documents d JOIN t ON d.lang = t.lang GROUP BY 1""")
def quantile_thresholds(spark, sf):
    d = table(spark, sf, "documents").select("lang", "n_chars")
    t = d.groupBy("lang").agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.95))).alias("q"), (F.avg("n_chars") + 2 * F.stddev_pop("n_chars")).alias("two_sigma"))
    x = d.join(t, "lang")
    q1, q3, p95 = (F.col("q")[i] for i in range(3))
    return x.groupBy("lang").agg(r6(F.max(q1)).alias("q1"), r6(F.max(q3)).alias("q3"), r6(F.max(p95)).alias("p95"), r6(F.max("two_sigma")).alias("two_sigma"), F.count_if(F.col("n_chars") > q3 + 1.5 * (q3 - q1)).alias("beyond"))


#: Share of the tokens that the core of a vocabulary makes up, bounds of its size, and bits that a word of a written text carries.
CORE, CORE_BOUNDS, WORD_BITS = 0.8, (10, 200), 22.5


@query(_PROFILE + f""", x AS (SELECT p.lang, p.h2, p.ttr, p.exponent, z.total FROM prof p JOIN zipf z USING (lang)), y AS (SELECT *, CAST(floor(round(total * ttr, 6)) AS BIGINT) AS vocabulary FROM x),
c AS (SELECT *, CAST(least(greatest(floor(CASE WHEN exponent <> 1 THEN pow({CORE}, 1.0 / greatest(1 - exponent, 0.01)) * vocabulary ELSE 0.2 * vocabulary END), {CORE_BOUNDS[0]}), {CORE_BOUNDS[1]}) AS BIGINT) AS states FROM y)
SELECT lang, round(pow(2, h2), 6) AS choices, vocabulary, states, CAST(floor(states * pow(2, h2)) AS BIGINT) AS transitions, round(h2 * total, 3) AS bits, CAST(floor(h2 * total / {WORD_BITS}) AS BIGINT) AS words, round(h2 * total / 8192, 6) AS kilobytes FROM c""")
def minimum_machine(spark, sf):
    """The least machine that could have made each language's text, from its entropy, vocabulary and exponent: states, transitions, and what the text can hold."""
    p = profile(spark, sf)
    total = stats.word_counts(token_docs(spark, sf), "lang").groupBy("lang").agg(F.sum("c").alias("total"))
    p = p.join(total, "lang").withColumn("vocabulary", F.floor(F.round(F.col("total") * F.col("ttr"), 6)))
    core = F.when(F.col("exponent") != 1, F.pow(F.lit(CORE), 1 / F.greatest(1 - F.col("exponent"), F.lit(0.01))) * F.col("vocabulary")).otherwise(0.2 * F.col("vocabulary"))
    p = p.withColumn("states", F.least(F.greatest(F.floor(core), F.lit(CORE_BOUNDS[0])), F.lit(CORE_BOUNDS[1])).cast("long"))
    bits = F.col("h2") * F.col("total")
    return p.select("lang", r6(F.pow(F.lit(2.0), F.col("h2"))).alias("choices"), "vocabulary", "states", F.floor(F.col("states") * F.pow(F.lit(2.0), F.col("h2"))).alias("transitions"), F.round(bits, 3).alias("bits"), F.floor(bits / WORD_BITS).alias("words"), r6(bits / 8192).alias("kilobytes"))
