"""Readers and writers: transliteration files, dictionaries, name lists, plain text, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalex.sources.transliteration import SPLIT, VARIABLES, read_pages


def clean_transliteration(raw: Column) -> Column:
    """Plain words of a transliterated line: comments and marks out, the first of uncertain readings, a-z and spaces left.

    The steps depend on their order: letters are lower-cased before all other
    signs go.
    """
    steps = [
        (r"<![^>]*>", ""), (r"<->", " "), (r"<~>", " "), (r"<\$>", ""), (r"[-=]+$", ""),
        (r"\[([^:\]]*?):[^\]]*?\]", "$1"), (r"\[([^\]]*?)\]", "$1"), (r"\{([^}]*)\}", "$1"),
    ]
    out = raw
    for rx, to in steps:
        out = F.regexp_replace(out, rx, to)
    out = F.lower(out)
    for rx, to in ((r"\.", " "), (r"[*?,']", ""), (r"@\d+;?", ""), (r"\s+", " "), (r"[^a-z ]", "")):
        out = F.regexp_replace(out, rx, to)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def locus_type(locus: Column) -> Column:
    """The letter of a locus id: the first of P, L, C, R, T, X after a dot and before a digit, else the first capital after a dot, else P."""
    first = [F.nullif(F.regexp_extract(locus, rx, 1), F.lit("")) for rx in (r"\.([PLCRTX])\d", r"\.([A-Z])")]
    return F.coalesce(*first, F.lit("P"))


def read_transliteration(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(file, offset, folio, the page's variables, locus, kind, text) of interlinear transliteration files, in splits of ``split_bytes``.

    Lines before the first page, comments and lines of no locus are left out. A missing path is an error.
    """
    rows = read_pages(spark, path, split_bytes)
    return rows.select("file", "offset", "folio", *VARIABLES, "locus", locus_type(F.col("locus")).alias("kind"), clean_transliteration(F.col("raw")).alias("text"))


def read_word_lists(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(list, word) of JSON objects of lists, or of one list (named ''): one a file, or (``lines``) one a line."""
    raw = spark.read.text(path, wholetext=not lines)
    lists = F.from_json("value", "map<string, array<string>>")
    one = F.from_json("value", "array<string>")
    both = F.when(F.ltrim("value").startswith("["), F.create_map(F.lit(""), one)).otherwise(lists)
    return raw.select(F.explode(both).alias("list", "words")).select("list", F.explode("words").alias("word"))


def read_species_names(spark: SparkSession, path: str) -> DataFrame:
    """(species, name) of a CSV whose second column lists names by commas; what stands in brackets goes."""
    raw = spark.read.csv(path, header=True)
    species, names = raw.columns[:2]
    split = F.explode(F.split(F.regexp_replace(F.col(f"`{names}`"), r"\([^)]*\)", ""), ",")).alias("name")
    return raw.select(F.trim(F.col(f"`{species}`")).alias("species"), split).select("species", F.lower(F.trim("name")).alias("name")).where("name <> ''")


#: Rounds of a text that one row makes at most.
ROUNDS = 65_536


def tiled_tokens(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(pos, tok): the words of a text repeated until there are ``n``.

    The files of the text follow each other by name. Words know their place from the
    counts of the files before, and the places to fill meet them by the rest of a division. A text without words gives none.
    """
    from stratalex.sources.tables import token_array

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), token_array(F.col("value")).alias("toks"))
    sizes = files.select("file", F.size("toks").alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    words = files.join(before, "file").select("before", "all", F.posexplode("toks").alias("at", "tok"))
    # each word fills the places that leave its number as rest; rounds come in blocks, which are dealt out
    number = F.col("before") + F.col("at")
    rounds = F.floor((F.lit(n) - 1 - number) / F.col("all"))
    block = words.where(number < n).select("tok", "all", number.alias("number"), rounds.alias("last"), F.explode(F.sequence(F.lit(0), F.floor(rounds / ROUNDS))).alias("block"))
    block = block.repartition("number", "block")
    each = F.sequence(F.col("block") * ROUNDS, F.least(F.col("last"), F.col("block") * ROUNDS + ROUNDS - 1))
    return block.select(F.explode(each).alias("round"), "all", "number", "tok").select((F.col("round") * F.col("all") + F.col("number")).alias("pos"), "tok")


def synthetic_sentences(spark: SparkSession, words: list[str], n: int, length: int = 8, seed: str = "s") -> DataFrame:
    """(id, text): sentences of words drawn by seeded hashes, the same on every run and at every parallelism."""
    lex = F.array(*map(F.lit, words))
    draw = lambda i: F.get(lex, F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(words))).cast("int"))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), draw), " ").alias("text"))


def write_result(df: DataFrame, path: str) -> None:
    """A result as JSON lines, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def stage_cache(spark: SparkSession, path: str, make) -> DataFrame:
    """A stage's table: read where it was written whole, else made and written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_folio_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, folio, text) of line-by-line transliterations ``<f1r.P1.1;H> words.by.dots``: tags out, dots as spaces.

    Each line tells its folio, so files are split anywhere. Lines that name no folio, and comments, are left out;
    a line without words gives an empty text. A missing path is an error.
    """
    raw = F.trim("value")
    rows = spark.read.text(path).where((raw != "") & ~raw.startswith("#")).withColumn("folio", F.regexp_extract(raw, r"^<(f\d+[rv]\d?)[.,]", 1))
    text = F.replace(F.trim(F.regexp_replace(raw, r"<[^>]+>", "")), F.lit("."), F.lit(" "))
    return rows.where("folio <> ''").select(F.col("_metadata.file_path").alias("file"), "folio", text.alias("text"))


def _pick(words: Column, *parts) -> Column:
    """One of ``words`` by the md5 of ``parts``, the same on every engine."""
    key = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.get(words, (F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % F.size(words)).cast("int"))


def templated_corpus(spark: SparkSession, templates: list[str], vocabulary: dict[str, list[str]], tokens: int, seed: str = "t") -> DataFrame:
    """(id, text): sentences of templates with slots ``{list}``, until ``tokens`` words are there.

    Each sentence is made from its number alone. Those that are needed are found
    from the sums of ranges of 4096 sentences, not by one running sum.
    """
    least = min(len(t.split()) for t in templates)
    rows = spark.range(-(-tokens // least)).select("id", _pick(F.array(*map(F.lit, templates)), F.lit(seed), F.col("id")).alias("t"))
    lists = F.create_map(*(x for k, v in sorted(vocabulary.items()) for x in (F.lit("{" + k + "}"), F.array(*map(F.lit, v)))))
    word = lambda w, i: F.when(F.element_at(lists, w).isNull(), w).otherwise(_pick(F.element_at(lists, w), F.lit(seed), F.col("id"), i))
    rows = rows.select("id", F.transform(F.split("t", " "), word).alias("w")).withColumn("n", F.size("w")).withColumn("part", F.floor(F.col("id") / 4096))
    sums = rows.groupBy("part").agg(F.sum("n").alias("s"))
    sums = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0))
    return rows.join(sums, "part").withColumn("at", at).where(F.col("at") < tokens).select("id", F.array_join("w", " ").alias("text"))


def weighted_words(spark: SparkSession, often: list[str], seldom: list[str], n: int, share: int = 6, seed: str = "w") -> DataFrame:
    """(pos, tok): ``n`` words, ``share`` tenths of them from the frequent list; each is made from its place alone."""
    tenth = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("d"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long") % 10
    pick = lambda words: _pick(F.array(*map(F.lit, words)), F.lit(seed), F.col("id"))
    return spark.range(n).select(F.col("id").alias("pos"), F.when(tenth < share, pick(often)).otherwise(pick(seldom)).alias("tok"))


def combined_report(results: dict[str, DataFrame]) -> DataFrame:
    """(name, row): the rows of several results as JSON, in one table that ``write_result`` can write."""
    out = None
    for name, df in sorted(results.items()):
        part = df.select(F.lit(name).alias("name"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
