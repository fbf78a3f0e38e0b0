"""Queries of word structure: affixes, paradigms, scalar word functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as ft
from stratalex.operators import stats
from stratalex.plans.registry import query
from stratalex.plans.sqltext import DICT, PAIRS, TOKENS, skeleton
from stratalex.sources.tables import dictionary, fixed, neighbours, token_docs

r6 = lambda c: F.round(c, 6)

_T = "types AS (SELECT tok, count(*) AS c FROM tokens GROUP BY 1)"


def _types(spark, sf):
    return stats.word_counts(token_docs(spark, sf))


def affixes(types, least: int = 5):
    """(kind, affix, n_words, ratio): beginnings and ends of 1 to 4 letters, over twice as frequent among words as by chance."""
    n = types.agg(F.count(F.lit(1)).alias("words"), F.size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.split("tok", "")))))).alias("alpha"))
    lens = F.when(F.length("tok") > 1, F.sequence(F.lit(1), F.least(F.lit(4), F.length("tok") - 1))).otherwise(F.array().cast("array<int>"))
    both = F.flatten(F.transform(lens, lambda k: F.array(
        F.struct(F.lit("prefix").alias("kind"), F.left("tok", k).alias("affix")), F.struct(F.lit("suffix").alias("kind"), F.right("tok", k).alias("affix")))))
    c = types.select(F.explode(both).alias("a")).groupBy("a.kind", "a.affix").agg(F.count(F.lit(1)).alias("n_words"))
    expected = F.col("words") / F.pow(F.col("alpha"), F.length("affix"))
    x = c.where(F.col("n_words") >= least).join(F.broadcast(n)).withColumn("ratio", F.col("n_words") / F.greatest(expected, F.lit(0.01)))
    return x.where("ratio > 2").select("kind", "affix", "n_words", "ratio")


_AFF = """aw AS (SELECT count(*) AS words FROM types), al AS (SELECT count(DISTINCT ch) AS alpha FROM (SELECT unnest(string_split(tok, '')) AS ch FROM types)),
ax AS (SELECT 'prefix' AS kind, substr(tok, 1, CAST(k AS BIGINT)) AS affix FROM types, range(1, 5) r(k) WHERE k < length(tok) UNION ALL SELECT 'suffix', right(tok, CAST(k AS BIGINT)) FROM types, range(1, 5) r(k) WHERE k < length(tok)),
ac AS (SELECT kind, affix, count(*) AS n_words FROM ax GROUP BY 1, 2 HAVING count(*) >= 5),
aff AS (SELECT kind, affix, n_words, n_words / greatest(words / pow(alpha, length(affix)), 0.01) AS ratio FROM ac, aw, al WHERE n_words / greatest(words / pow(alpha, length(affix)), 0.01) > 2)"""


@query(f"WITH {TOKENS}, {_T}, {_AFF} SELECT kind, affix, n_words, round(ratio, 4) AS ratio FROM aff")
def productive_affixes(spark, sf):
    return affixes(_types(spark, sf)).withColumn("ratio", F.round("ratio", 4))


_TOP30 = "t30 AS (SELECT kind, affix FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_words DESC, affix) AS k FROM aff) WHERE k <= 30)"
_STRIP = f"""{_TOP30}, p1 AS (SELECT t.tok, t.c, coalesce((SELECT max(affix) FROM t30 WHERE kind = 'prefix' AND length(affix) = (SELECT max(length(affix)) FROM t30 WHERE kind = 'prefix' AND length(affix) < length(t.tok) AND starts_with(t.tok, affix)) AND starts_with(t.tok, affix)), '') AS prefix FROM types t),
p2 AS (SELECT tok, c, prefix, substr(tok, length(prefix) + 1) AS rest FROM p1),
p3 AS (SELECT tok, c, prefix, rest, coalesce((SELECT max(affix) FROM t30 WHERE kind = 'suffix' AND length(affix) = (SELECT max(length(affix)) FROM t30 WHERE kind = 'suffix' AND length(affix) < length(p2.rest) AND ends_with(p2.rest, affix)) AND ends_with(p2.rest, affix)), '') AS suffix FROM p2),
st AS (SELECT tok, c, prefix, substr(rest, 1, length(rest) - length(suffix)) AS stem, suffix FROM p3)"""


def stripped(spark, sf, limit: int = 30):
    """(tok, c, prefix, stem, suffix): the longest of the ``limit`` most productive prefixes, then suffixes, that leave a stem."""
    types = _types(spark, sf)
    w = Window.partitionBy("kind").orderBy(F.desc("n_words"), "affix")
    top = affixes(types).withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    lists = top.groupBy().agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("affix"))).alias(k + "es") for k in ("prefix", "suffix")))
    x = types.join(F.broadcast(lists))  # two lists of 30

    def longest(found):
        n = F.array_max(F.transform(found, F.length))
        return F.coalesce(F.array_max(F.filter(found, lambda a: F.length(a) == n)), F.lit(""))

    tok = F.col("tok")
    x = x.withColumn("prefix", longest(F.filter("prefixes", lambda a: tok.startswith(a) & (F.length(a) < F.length(tok)))))
    x = fixed(x.withColumn("rest", F.substring("tok", F.length("prefix") + 1, F.length("tok"))), "tok", "c", "prefix", "rest", "suffixes")
    rest = F.col("rest")
    x = x.withColumn("suffix", longest(F.filter("suffixes", lambda a: rest.endswith(a) & (F.length(a) < F.length(rest)))))
    x = fixed(x, "tok", "c", "prefix", "rest", "suffix")
    return x.select("tok", "c", "prefix", F.substring("rest", F.lit(1), F.length("rest") - F.length("suffix")).alias("stem"), "suffix")


@query(f"WITH {TOKENS}, {_T}, {_AFF}, {_STRIP} SELECT tok, prefix, stem, suffix FROM st")
def affix_strip(spark, sf):
    return stripped(spark, sf).select("tok", "prefix", "stem", "suffix")


@query(f"""WITH {TOKENS}, {_T}, {_AFF}, {_STRIP}, a AS (SELECT prefix, suffix, CAST(sum(c) AS BIGINT) AS c FROM st WHERE prefix <> '' AND suffix <> '' GROUP BY 1, 2)
SELECT prefix, suffix, c FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY c DESC, suffix) AS k FROM a) WHERE k = 1""")
def affix_alignment(spark, sf):
    """The suffix that goes with each prefix most often."""
    a = stripped(spark, sf).where("prefix <> '' and suffix <> ''").groupBy("prefix", "suffix").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("prefix").orderBy(F.desc("c"), "suffix")
    return a.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@query(f"""WITH {TOKENS}, {_T}, s AS (SELECT substr(tok, 1, CAST(k AS BIGINT)) AS stem, tok, substr(tok, CAST(k AS BIGINT) + 1) AS suf FROM types, range(2, 6) r(k) WHERE c >= 2 AND k < length(tok)),
g AS (SELECT stem, count(*) AS members, count(DISTINCT suf) AS suffixes, array_to_string(list_sort(list(tok)), ' ') AS words FROM s GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT suf) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY length(stem), stem) AS k FROM g)
SELECT stem, members, suffixes, md5(words) AS words_md5 FROM r WHERE k = 1""")
def paradigms(spark, sf):
    """Stems of 2 to 5 letters with three words or more; of stems with the same words the shortest."""
    t = _types(spark, sf).where("c >= 2 and length(tok) > 2")
    s = t.select("tok", F.explode(F.sequence(F.lit(2), F.least(F.lit(5), F.length("tok") - 1))).alias("k"))
    s = s.select(F.left("tok", F.col("k")).alias("stem"), "tok", F.substring("tok", F.col("k") + 1, F.length("tok")).alias("suf"))
    g = s.groupBy("stem").agg(F.count(F.lit(1)).alias("members"), F.size(F.collect_set("suf")).cast("long").alias("suffixes"), F.concat_ws(" ", F.sort_array(F.collect_list("tok"))).alias("words"))
    g = g.where("members >= 3 and suffixes >= 3")
    r = g.withColumn("k", F.row_number().over(Window.partitionBy("words").orderBy(F.length("stem"), "stem")))
    return r.where("k = 1").select("stem", "members", "suffixes", F.md5("words").alias("words_md5"))


def _borders(docs):
    """(lang, c1, c2, n): the last letter of a word and the first of the next; 26 x 26 rows a language and task move, never pairs of words."""
    pairs = docs.select("lang", F.explode(neighbours(F.col("toks"))).alias("b"))
    return pairs.groupBy("lang", F.right("b.w1", F.lit(1)).alias("c1"), F.left("b.w2", F.lit(1)).alias("c2")).agg(F.count(F.lit(1)).alias("n"))


_BND = "bd AS (SELECT lang, right(w1, 1) AS c1, substr(w2, 1, 1) AS c2, count(*) AS n FROM pairs WHERE w2 IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"""WITH {TOKENS}, {PAIRS}, {_BND}, t AS (SELECT lang, sum(n) AS t FROM bd GROUP BY 1), j AS (SELECT lang, -sum(n / t * log2(n / t)) AS h FROM bd JOIN t USING (lang) GROUP BY 1),
a AS (SELECT lang, -sum(n / t * log2(n / t)) AS h FROM (SELECT lang, c1, sum(n) AS n FROM bd GROUP BY 1, 2) JOIN t USING (lang) GROUP BY 1), e AS (SELECT lang, -sum(n / t * log2(n / t)) AS h FROM (SELECT lang, c2, sum(n) AS n FROM bd GROUP BY 1, 2) JOIN t USING (lang) GROUP BY 1)
SELECT lang, round(j.h - a.h, 6) AS boundary_h, round(a.h + e.h - j.h, 6) AS mi FROM j JOIN a USING (lang) JOIN e USING (lang)""")
def boundary_mi(spark, sf):
    """Entropy of a word's first letter given the last one before it, and what they tell of each other."""
    bd = _borders(token_docs(spark, sf))
    j = bd.groupBy("lang").agg(stats.bits("n").alias("j"))
    a = bd.groupBy("lang", "c1").agg(F.sum("n").alias("n")).groupBy("lang").agg(stats.bits("n").alias("a"))
    e = bd.groupBy("lang", "c2").agg(F.sum("n").alias("n")).groupBy("lang").agg(stats.bits("n").alias("e"))
    x = j.join(a, "lang").join(e, "lang")
    return x.select("lang", r6(F.col("j") - F.col("a")).alias("boundary_h"), r6(F.col("a") + F.col("e") - F.col("j")).alias("mi"))


@query(f"""WITH {TOKENS}, {PAIRS}, {_BND}, t AS (SELECT lang, sum(n) AS t FROM bd GROUP BY 1), a AS (SELECT lang, c1, sum(n) AS na FROM bd GROUP BY 1, 2), e AS (SELECT lang, c2, sum(n) AS ne FROM bd GROUP BY 1, 2)
SELECT lang, c1, c2, n, round(n * t / (na * ne), 4) AS lift FROM bd JOIN t USING (lang) JOIN a USING (lang, c1) JOIN e USING (lang, c2) WHERE n >= 10 AND n * t / (na * ne) > 1.5""")
def strong_boundaries(spark, sf):
    bd = _borders(token_docs(spark, sf))
    s = lambda *k: F.sum("n").over(Window.partitionBy("lang", *k))
    x = bd.withColumn("lift", F.col("n") * s() / (s("c1") * s("c2")))
    return x.where("n >= 10 and lift > 1.5").select("lang", "c1", "c2", "n", F.round("lift", 4).alias("lift"))


@query(f"""WITH {TOKENS}, {_T}, s AS (SELECT c, substr(tok, 1, 1) AS a, substr(tok, 2, 1) AS b, right(tok, 1) AS z FROM types WHERE length(tok) >= 3),
u AS (SELECT 'a' AS s1, 'b' AS s2, a AS x, b AS y, c FROM s UNION ALL SELECT 'a', 'z', a, z, c FROM s UNION ALL SELECT 'b', 'z', b, z, c FROM s), n AS (SELECT s1, s2, x, y, sum(c) AS n FROM u GROUP BY 1, 2, 3, 4),
m AS (SELECT s1, s2, n / sum(n) OVER (PARTITION BY s1, s2) AS p, sum(n) OVER (PARTITION BY s1, s2, x) / sum(n) OVER (PARTITION BY s1, s2) AS px, sum(n) OVER (PARTITION BY s1, s2, y) / sum(n) OVER (PARTITION BY s1, s2) AS py FROM n)
SELECT s1, s2, round(sum(p * log2(p / (px * py))), 6) AS mi FROM m GROUP BY 1, 2""")
def slot_mi(spark, sf):
    t = _types(spark, sf).where("length(tok) >= 3")
    slot = {"a": F.left("tok", F.lit(1)), "b": F.substring("tok", 2, 1), "z": F.right("tok", F.lit(1))}
    pairs = F.array(*(F.struct(F.lit(i).alias("s1"), F.lit(j).alias("s2"), slot[i].alias("x"), slot[j].alias("y")) for i, j in (("a", "b"), ("a", "z"), ("b", "z"))))
    n = t.select("c", F.explode(pairs).alias("u")).groupBy("u.s1", "u.s2", "u.x", "u.y").agg(F.sum("c").alias("n"))
    s = lambda *k: F.sum("n").over(Window.partitionBy("s1", "s2", *k))
    p = F.col("n") / s()
    m = n.select("s1", "s2", (p * F.log2(p / (s("x") / s() * s("y") / s()))).alias("i"))
    return m.groupBy("s1", "s2").agg(r6(F.sum("i")).alias("mi"))


@query(f"WITH {TOKENS}, {_T} SELECT tok, {skeleton('tok')} AS skel FROM types")
def latin_skeleton(spark, sf):
    return _types(spark, sf).select("tok", ft.skeleton(F.col("tok")).alias("skel"))


def _vowel_sql(w):
    s = f"regexp_replace(translate({w}, 'ckqgtdpbvfszxlrmn', 'KKKKTTPPPPSSSLRMN'), '[^A-Z]', 'v', 'g')"
    for c in "KTPSLRMN":
        s = f"regexp_replace({s}, '{c}+', '{c}', 'g')"
    return f"rtrim(regexp_replace(upper({s}), '(.)', '\\1-', 'g'), '-')"


@query(f"WITH {TOKENS}, {_T} SELECT tok, {_vowel_sql('tok')} AS skel FROM types")
def vowel_skeleton(spark, sf):
    return _types(spark, sf).select("tok", ft.vowel_skeleton(F.col("tok")).alias("skel"))


_CIPHER = "regexp_extract_all(tok, '(ch|sh|in|ck|ct|[a-z])')"
_MAP = "map {'k': 'K', 't': 'T', 'p': 'P', 'f': 'P', 'ch': 'K', 'c': 'K', 'sh': 'S', 's': 'S', 'l': 'L', 'r': 'R', 'm': 'M', 'n': 'N', 'in': 'N', 'd': 'T', 'ck': 'K', 'ct': 'T'}"


@query(f"WITH {TOKENS}, {_T} SELECT tok, array_to_string(list_filter(list_transform({_CIPHER}, lambda s: {_MAP}[s]), lambda s: s IS NOT NULL), '-') AS skel FROM types")
def cipher_skeleton(spark, sf):
    return _types(spark, sf).select("tok", ft.cipher_skeleton(F.col("tok")).alias("skel"))


_STEM = "CASE " + " ".join(f"WHEN tok LIKE '%{s}' AND length(tok) - {len(s)} >= 3 THEN substr(tok, 1, length(tok) - {len(s)})" for s in ft.STEM_SUFFIXES) + " ELSE tok END"


@query(f"WITH {TOKENS}, {_T} SELECT {_STEM} AS stem, count(*) AS types, CAST(sum(c) AS BIGINT) AS total FROM types GROUP BY 1")
def latin_stem(spark, sf):
    return _types(spark, sf).groupBy(ft.stem(F.col("tok")).alias("stem")).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("total"))


def _case(affs, test):
    return "CASE " + " ".join(f"WHEN {test.format(a=a)} AND length(s) > {len(a) + 2} THEN '{a}'" for a in affs) + " ELSE '' END"


@query(f"""WITH {TOKENS}, {_T}, a AS (SELECT tok, tok AS s FROM types), b AS (SELECT tok, {_case(ft.PARSE_PREFIXES, "s LIKE '{a}%'")} AS prefix FROM a),
e AS (SELECT tok, prefix, substr(tok, length(prefix) + 1) AS s FROM b), g AS (SELECT tok, prefix, s, {_case(ft.PARSE_SUFFIXES, "s LIKE '%{a}'")} AS suffix FROM e)
SELECT tok, prefix, substr(s, 1, length(s) - length(suffix)) AS stem, suffix FROM g""")
def latin_parse(spark, sf):
    x = _types(spark, sf).select("tok", ft.parse_prefix(F.col("tok")).alias("prefix"))
    x = x.withColumn("rest", F.substring("tok", F.length("prefix") + 1, F.length("tok"))).withColumn("suffix", ft.parse_suffix(F.col("rest")))
    return x.select("tok", "prefix", F.substring("rest", F.lit(1), F.length("rest") - F.length("suffix")).alias("stem"), "suffix")


_ENDINGS = ["a", "ae", "am", "is", "um", "o", "us", "i", "e", "em", "es"]


@query(f"""WITH {DICT}, s AS (SELECT word, {_STEM.replace('tok', 'word')} AS stem FROM dict) SELECT word, f AS form FROM (SELECT DISTINCT word, unnest(list_concat([word], [{", ".join(f"stem || '{e}'" for e in _ENDINGS)}])) AS f FROM s) WHERE length(f) >= 4 OR f = word""")
def inflections(spark, sf):
    """Forms of each word: its stem with common endings, of four letters or more, and itself."""
    d = dictionary(spark, sf).select("word", ft.stem(F.col("word")).alias("stem"))
    forms = F.array_distinct(F.array(F.col("word"), *(F.concat("stem", F.lit(e)) for e in _ENDINGS)))
    return d.select("word", F.explode(forms).alias("form")).where((F.length("form") >= 4) | (F.col("form") == F.col("word")))


@query(f"""WITH {DICT}, s AS (SELECT word, {_STEM.replace('tok', 'word')} AS st, x AS sf FROM dict, (SELECT unnest(['a', 'ae', 'e', 'i', 'is', 't', 'um']) AS x))
SELECT word, sf AS suffix, CASE WHEN right(st, 1) = 'e' AND sf LIKE 'e%' THEN substr(st, 1, length(st) - 1) || sf WHEN right(st, 1) = 'a' AND sf = 'a' THEN st WHEN right(st, 1) = 'i' AND sf LIKE 'i%' THEN substr(st, 1, length(st) - 1) || sf
  WHEN sf = 't' AND right(st, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN st || 'it' ELSE st || sf END AS form FROM s""")
def synthesize(spark, sf):
    sufs = F.array(*(F.lit(x) for x in ("a", "ae", "e", "i", "is", "t", "um")))
    d = dictionary(spark, sf).select("word", ft.stem(F.col("word")).alias("st"), F.explode(sufs).alias("suffix"))
    return d.select("word", "suffix", ft.synthesize(F.col("st"), F.col("suffix")).alias("form"))


_SYL = """sy AS (SELECT tok, c, regexp_extract_all(tok, '[^aeiouy]*[aeiouy]') AS o, regexp_extract(tok, '([^aeiouy]*)$', 1) AS tail FROM types),
sl AS (SELECT tok, c, CASE WHEN len(o) = 0 THEN [tok] ELSE list_concat(o[1:len(o) - 1], [o[len(o)] || tail]) END AS syl FROM sy)"""


@query(f"WITH {TOKENS}, {_T}, {_SYL} SELECT tok, CAST(len(syl) AS BIGINT) AS n, array_to_string(syl, '-') AS syllables FROM sl")
def syllabify(spark, sf):
    s = ft.syllables(F.col("tok"))
    return _types(spark, sf).select("tok", F.size(s).cast("long").alias("n"), F.array_join(s, "-").alias("syllables"))


@query(f"""WITH {TOKENS}, {_T}, {_SYL}, e AS (SELECT unnest(syl) AS s, c FROM sl), p AS (SELECT regexp_extract(s, '^(([^aeiouyq]*qu)|[^aeiouy]*)((ae|oe|au|eu)|[aeiouy]?)(.*)$', 1) AS onset,
  regexp_extract(s, '^(([^aeiouyq]*qu)|[^aeiouy]*)((ae|oe|au|eu)|[aeiouy]?)(.*)$', 3) AS nucleus, regexp_extract(s, '^(([^aeiouyq]*qu)|[^aeiouy]*)((ae|oe|au|eu)|[aeiouy]?)(.*)$', 5) AS coda, c FROM e)
SELECT onset, nucleus, coda, CASE WHEN coda = '' THEN 'open' ELSE 'closed' END AS kind, CAST(sum(c) AS BIGINT) AS c FROM p GROUP BY 1, 2, 3, 4""")
def syllable_structure(spark, sf):
    x = _types(spark, sf).select("c", F.explode(ft.syllables(F.col("tok"))).alias("s")).select("c", ft.syllable_parts(F.col("s")).alias("p"))
    return x.groupBy("p.onset", "p.nucleus", "p.coda", F.when(F.col("p.coda") == "", "open").otherwise("closed").alias("kind")).agg(F.sum("c").alias("c"))


@query(f"""WITH {TOKENS}, {_T}, a AS (SELECT tok, string_split(tok, '') AS ch FROM types),
u AS (SELECT tok, unnest(ch) AS c, unnest(range(len(ch))) AS i FROM a), f AS (SELECT tok, c, min(i) AS fi FROM u GROUP BY 1, 2), rk AS (SELECT tok, c, row_number() OVER (PARTITION BY tok ORDER BY fi) AS r FROM f),
s AS (SELECT u.tok, string_agg(chr(CAST(64 + r AS INT)), '' ORDER BY i) AS sig FROM u JOIN rk ON rk.tok = u.tok AND rk.c = u.c GROUP BY 1)
SELECT sig, count(*) AS types, min(tok) AS first_word FROM s GROUP BY 1""")
def pattern_signature(spark, sf):
    t = _types(spark, sf).select("tok", ft.pattern_signature(F.col("tok")).alias("sig"))
    return t.groupBy("sig").agg(F.count(F.lit(1)).alias("types"), F.min("tok").alias("first_word"))


@query(f"""WITH {TOKENS}, {_T}, {DICT}, ua AS (SELECT tok, string_split(tok, '') AS ch FROM (SELECT tok FROM types WHERE c = 1 UNION SELECT word FROM dict)),
u AS (SELECT tok, unnest(ch) AS c, unnest(range(len(ch))) AS i FROM ua), f AS (SELECT tok, c, min(i) AS fi FROM u GROUP BY 1, 2), rk AS (SELECT tok, c, row_number() OVER (PARTITION BY tok ORDER BY fi) AS r FROM f),
s AS (SELECT u.tok, string_agg(chr(CAST(64 + r AS INT)), '' ORDER BY i) AS sig FROM u JOIN rk ON rk.tok = u.tok AND rk.c = u.c GROUP BY 1)
SELECT t.tok, count(*) AS matches, min(d.word) AS first_match FROM types t JOIN s a ON a.tok = t.tok JOIN s b ON b.sig = a.sig JOIN dict d ON d.word = b.tok WHERE t.c = 1 GROUP BY 1""")
def pattern_matches(spark, sf):
    """Words that occur once against dictionary words of the same pattern: the dictionary is counted by pattern first."""
    d = dictionary(spark, sf).groupBy(ft.pattern_signature(F.col("word")).alias("sig")).agg(F.count(F.lit(1)).alias("matches"), F.min("word").alias("first_match"))
    t = _types(spark, sf).where("c = 1").select("tok", ft.pattern_signature(F.col("tok")).alias("sig"))
    return t.join(d, "sig").select("tok", "matches", "first_match")


def _rewrite_sql(alphabet):
    s = "tok"
    for k in sorted(alphabet, key=lambda x: -len(x)):
        s = f"replace({s}, '{k}', '{alphabet[k]}')"
    return s


@query(f"WITH {TOKENS}, {_T} SELECT tok, {_rewrite_sql(ft.SIGN_GROUPS)} AS merged, {_rewrite_sql(ft.SIGN_ROLES)} AS functional FROM types")
def retranscribe(spark, sf):
    return _types(spark, sf).select("tok", ft.rewrite(F.col("tok"), ft.SIGN_GROUPS).alias("merged"), ft.rewrite(F.col("tok"), ft.SIGN_ROLES).alias("functional"))


_TAGS = "CASE " + " ".join(f"WHEN tok LIKE '%{s}' AND length(tok) > {len(s)} THEN '{ft.SUFFIX_TAGS[s]}'" for s in sorted(ft.SUFFIX_TAGS, key=lambda x: -len(x))) + " ELSE 'UNK' END"


@query(f"WITH {TOKENS}, {_T} SELECT {_TAGS} AS tag, count(*) AS types, CAST(sum(c) AS BIGINT) AS total FROM types GROUP BY 1")
def suffix_tags(spark, sf):
    return _types(spark, sf).groupBy(ft.suffix_tag(F.col("tok")).alias("tag")).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("total"))


@query(f"WITH {TOKENS} SELECT doc_id, md5(array_to_string(list_reverse(toks), ' ')) AS reversed_md5, CAST(len(toks) AS BIGINT) AS n FROM d")
def reversed_text(spark, sf):
    return token_docs(spark, sf).select("doc_id", F.md5(F.array_join(F.reverse("toks"), " ")).alias("reversed_md5"), F.size("toks").cast("long").alias("n"))


@query(f"""WITH {TOKENS}, {_T}, x AS (SELECT tok, length(tok) AS n, unnest(string_split(tok, '')) AS ch, unnest(range(length(tok))) AS i FROM types)
SELECT tok, string_agg(ch, '' ORDER BY md5('7|' || tok || '|' || i), i) AS scrambled FROM x GROUP BY 1""")
def scrambled_words(spark, sf):
    """Letters of each word in the order of a seeded hash: the same on every engine and at every size."""
    chars = F.filter(F.split("tok", ""), lambda c: c != "")
    keyed = F.transform(chars, lambda c, i: F.struct(F.md5(F.concat_ws("|", F.lit("7"), "tok", i.cast("string"))).alias("k"), i.alias("i"), c.alias("c")))
    return _types(spark, sf).select("tok", F.array_join(F.transform(F.array_sort(keyed), lambda s: s["c"]), "").alias("scrambled"))


# Modifiers and bodies of the grid; the last four bodies are added for the languages of the tables.
_MODS = ["", "l", "qo", "y", "o"]
_BODIES = ["edy", "eedy", "eey", "aiin", "ain", "aiir", "tion", "ing", "er", "ed"]


@query(f"""WITH {TOKENS}, {_T}, b AS (SELECT tok, c, regexp_extract(tok, '^(.+?)({"|".join(_BODIES)})$', 1) AS onset, regexp_extract(tok, '^(.+?)({"|".join(_BODIES)})$', 2) AS body FROM types), o AS (SELECT c, body, CASE WHEN onset LIKE 'qo%' THEN 'qo' WHEN onset LIKE 'l%' THEN 'l' WHEN onset LIKE 'y%' THEN 'y' WHEN onset LIKE 'o%' THEN 'o' ELSE '' END AS modifier FROM b WHERE body <> ''),
m AS (SELECT unnest(['', 'l', 'qo', 'y', 'o']) AS modifier), bs AS (SELECT DISTINCT body FROM o)
SELECT m.modifier, bs.body, CAST(coalesce(sum(o.c), 0) AS BIGINT) AS c, coalesce(sum(o.c), 0) > 0 AS filled FROM m CROSS JOIN bs LEFT JOIN o ON o.modifier = m.modifier AND o.body = bs.body GROUP BY 1, 2""")
def onset_grid(spark, sf):
    """Modifier by body: filled and empty cells of a grid of fixed size."""
    rx = f"^(.+?)({'|'.join(_BODIES)})$"
    b = _types(spark, sf).select("c", F.regexp_extract("tok", rx, 1).alias("onset"), F.regexp_extract("tok", rx, 2).alias("body")).where("body <> ''")
    on = F.col("onset")
    mod = F.when(on.startswith("qo"), "qo").when(on.startswith("l"), "l").when(on.startswith("y"), "y").when(on.startswith("o"), "o").otherwise("")
    n = b.groupBy(mod.alias("modifier"), "body").agg(F.sum("c").alias("c"))
    grid = n.select("body").distinct().select(F.explode(F.array(*map(F.lit, _MODS))).alias("modifier"), "body")
    return grid.join(n, ["modifier", "body"], "left").select("modifier", "body", F.coalesce("c", F.lit(0)).alias("c"), F.col("c").isNotNull().alias("filled"))
