"""Queries of the readers and writers: tables written as files in the shared folder, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.plans.models import draw_sql
from stratalex.plans.registry import query
from stratalex.session import scratch
from stratalex.sources import readers as rd
from stratalex.sources.readers import clean_transliteration
from stratalex.sources.tables import dictionary, fixed, spread, table, token_array, token_docs
from stratalex.sources.transliteration import write_pages

#: A page a document: the page's variables, as SQL of both engines.
PAGE = {
    "folio": "concat('f', doc_id, CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE 'v' END)", "quire": "doc_id % 20 + 1", "page_num": "doc_id",
    "language": "CASE WHEN lang IN ('en', 'fr') THEN 'A' WHEN lang IS NOT NULL THEN 'B' END", "hand": "length(source) % 5 + 1",
    "illustration": "substr('HABCPSTZ', CAST(doc_id % 8 AS INT) + 1, 1)", "cluster": "lang",
}


def _pages(spark, sf):
    """Documents as pages. Their lines get uncertain readings, ligatures, marks, comments and capitals, which a reader has to undo."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), token_array), lambda w: F.size(w) > 0)
    mark = lambda w, i: F.element_at(F.array(w, F.concat(F.lit("["), w, F.lit(":o]")), F.concat(F.lit("{"), w, F.lit("}")), F.concat(w, F.lit("*")), F.upper(w), F.concat(w, F.lit("@152;")), F.concat(w, F.lit("<!or>"))), i % 7 + 1)
    locus = lambda w, k: F.concat("folio", F.when(F.size(w) > 3, ".P1.").otherwise(".L1."), (k + 1).cast("string"), F.lit(";H"))
    ends = F.array(*map(F.lit, ("", "-", "=", "<$>")))
    line = lambda w, k: F.struct(locus(w, k).alias("locus"), F.concat(F.array_join(F.transform(w, mark), "."), F.element_at(ends, k % 4 + 1)).alias("text"))
    pages = fixed(docs.select(*(F.expr(x).alias(name) for name, x in PAGE.items()), lines.alias("lines")), *PAGE, "lines")
    return pages.select(*PAGE, F.transform("lines", line).alias("loci"))


_LINES = f"""WITH d AS (SELECT {", ".join(f"{x} AS {name}" for name, x in PAGE.items())}, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT d.* EXCLUDE (ls), i, list_filter(regexp_split_to_array(lower(ls[i]), '[^a-z]+'), lambda x: x <> '') AS w FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY folio ORDER BY i) AS k FROM l WHERE len(w) > 0)"""


@query(_LINES + """ SELECT folio, quire, page_num, language, hand, illustration, cluster, folio || CASE WHEN len(w) > 3 THEN '.P1.' ELSE '.L1.' END || k || ';H' AS locus,
CASE WHEN len(w) > 3 THEN 'P' ELSE 'L' END AS kind, array_to_string(w, ' ') AS text FROM k""")
def transliteration_scan(spark, sf):
    """Documents written as interlinear pages and read again: variables of the page, kind and cleaned words of each locus."""
    path = scratch(spark, "pages")
    write_pages(_pages(spark, sf), path)
    return rd.read_transliteration(spark, path).drop("file", "offset")


@query(_LINES + " SELECT folio, count(*) AS lines, CAST(sum(len(w)) AS BIGINT) AS words, md5(max(array_to_string(w, ' '))) AS last_md5 FROM k GROUP BY 1")
def folio_line_scan(spark, sf):
    """Documents written line by line and read again by their folio."""
    path = scratch(spark, "lines")
    plain = _pages(spark, sf).select(F.explode("loci").alias("l")).select(F.concat(F.lit("<"), F.col("l.locus"), F.lit("> "), F.replace(clean_transliteration(F.col("l.text")), F.lit(" "), F.lit("."))).alias("value"))
    plain.write.text(path)
    l = rd.read_folio_lines(spark, path)
    return l.groupBy("folio").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size(F.split("text", " "))).alias("words"), F.md5(F.max("text")).alias("last_md5"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')) AS word FROM documents)
SELECT 'doc_' || doc_id AS list, word, count(*) AS n FROM w GROUP BY 1, 2""")
def word_list_scan(spark, sf):
    """Word lists written as JSON objects, one a document, and read again."""
    path = scratch(spark, "lists")
    docs = token_docs(spark, sf)
    docs.select(F.to_json(F.create_map(F.concat(F.lit("doc_"), "doc_id"), "toks")).alias("value")).write.text(path)
    return rd.read_word_lists(spark, path, lines=True).groupBy("list", "word").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT p_name, list(DISTINCT p_brand) AS b, list(DISTINCT p_type) AS t FROM part GROUP BY 1), x AS (SELECT p_name, unnest(list_concat(b, t)) AS name FROM n)
SELECT DISTINCT p_name AS species, lower(name) AS name FROM x""")
def species_name_scan(spark, sf):
    """Names by kind of part written as a CSV with comments in brackets, and read again."""
    path = scratch(spark, "names")
    parts = table(spark, sf, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("b"), F.array_sort(F.collect_set("p_type")).alias("t"))
    names = F.array_join(F.concat(F.transform("b", lambda x: F.concat(x, F.lit(" (brand)"))), F.transform("t", lambda x: F.concat(F.upper(x), F.lit(" "))), F.array(F.lit(""))), ", ")
    parts.select(F.col("p_name").alias("Species"), names.alias("Names"), F.lit("x").alias("Notes")).write.option("header", True).csv(path)
    return rd.read_species_names(spark, path)


@query("""WITH b AS (SELECT list_filter(regexp_split_to_array(lower(string_agg(coalesce(text, ''), chr(10) ORDER BY item_id)), '[^a-z]+'), lambda x: x <> '') AS t FROM benchmark),
n AS (SELECT 40 * count(*) AS n FROM documents), r AS (SELECT unnest(range(n)) AS pos FROM n) SELECT pos, t[pos % len(t) + 1] AS tok FROM r, b""")
def tiled_corpus(spark, sf):
    """A reference text written as one file, repeated until there are forty words for each document."""
    path = scratch(spark, "text")
    table(spark, sf, "benchmark").select("item_id", "text").coalesce(1).sortWithinPartitions("item_id").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return rd.tiled_tokens(spark, path, 40 * table(spark, sf, "documents").count())


_TEMPLATES = ["recipe {plant} and {verb} it", "{plant} is good", "take {plant} {plant} {verb}"]
_TPL = "[" + ", ".join(f"'{t}'" for t in _TEMPLATES) + "]"


def _slot_sql():
    out = "w"
    for k, arr in (("plant", "plants"), ("verb", "verbs")):
        out = f"CASE WHEN w = '{{{k}}}' THEN {arr}[{draw_sql(f'len({arr})', chr(39) + 't' + chr(39), 'id', 'k')} + 1] ELSE {out} END"
    return out


@query(f"""WITH v AS (SELECT (SELECT list(n_name ORDER BY n_nationkey) FROM nation) AS plants, (SELECT list(r_name ORDER BY r_regionkey) FROM region) AS verbs), z AS (SELECT 20 * count(*) AS z FROM documents),
i AS (SELECT unnest(range((z + 2) // 3)) AS id FROM z), s AS (SELECT id, string_split({_TPL}[{draw_sql(len(_TEMPLATES), "'t'", 'id')} + 1], ' ') AS ws FROM i), u AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM s),
n AS (SELECT id, count(*) AS n, string_agg({_slot_sql()}, ' ' ORDER BY k) AS text FROM u, v GROUP BY 1) SELECT id, text FROM (SELECT *, sum(n) OVER (ORDER BY id) - n AS upto FROM n), z WHERE upto < z""")
def synthetic_corpus(spark, sf):
    """Sentences of templates with the names of nations and regions (tables of fixed size), until there are twenty words for each document."""
    names = {"plant": [r[0] for r in table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()], "verb": [r[0] for r in table(spark, sf, "region").orderBy("r_regionkey").select("r_name").collect()]}
    return rd.templated_corpus(spark, _TEMPLATES, names, 20 * table(spark, sf, "documents").count())


_RANKED = "SELECT lower(w) AS w, count(*) AS c FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1"


@query(f"""WITH f AS (SELECT w, row_number() OVER (ORDER BY c DESC, w) AS k FROM ({_RANKED})), v AS (SELECT list(w ORDER BY k) FILTER (k <= 20) AS often, list(w ORDER BY k) FILTER (k > 20 AND k <= 200) AS seldom FROM f),
i AS (SELECT unnest(range(z)) AS id FROM (SELECT 40 * count(*) AS z FROM documents))
SELECT id AS pos, CASE WHEN {draw_sql(10, "'w'", "'d'", 'id')} < 6 THEN often[{draw_sql('len(often)', "'w'", 'id')} + 1] ELSE seldom[{draw_sql('len(seldom)', "'w'", 'id')} + 1] END AS tok FROM i, v""")
def weighted_corpus(spark, sf):
    """Words of the twenty most frequent of a reference text and of the next 180, six of ten from the first; forty for each document."""
    top = [r[0] for r in dictionary(spark, sf).orderBy(F.desc("freq"), "word").limit(200).select("word").collect()]
    return rd.weighted_words(spark, top[:20], top[20:], 40 * table(spark, sf, "documents").count())


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def stage_cache_read(spark, sf):
    """A stage's table, made at first and read the second time."""
    path = scratch(spark, "stage")
    make = lambda: table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rd.stage_cache(spark, path, make)
    return rd.stage_cache(spark, path, lambda: spark.range(0).selectExpr("'' AS lang", "id AS n"))


@query("""WITH p AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT count(*) AS n FROM labels)
SELECT 'languages' AS name, '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n":' || n || '}' AS row FROM p UNION ALL SELECT 'labels', '{"n":' || n || '}' FROM l""")
def report_round_trip(spark, sf):
    """Several results as one report, written as JSON lines and read again."""
    n = F.count(F.lit(1)).alias("n")
    report = rd.combined_report({"languages": table(spark, sf, "documents").groupBy("lang").agg(n), "labels": table(spark, sf, "labels").agg(n)})
    path = scratch(spark, "report")
    rd.write_result(report, path)
    return spark.read.schema(report.schema).json(path)


