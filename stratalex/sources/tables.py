"""Tables of the engine: documents as token arrays, tokens, and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; a missing table is an error, never a silent fallback."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_array(text: Column) -> Column:
    """Lower-case runs of a-z, in order; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda x: x != "")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key`` where they come in fewer partitions than there are cores; otherwise as they are.

    A file of one row group is one task whatever its size. Texts are small to
    move beside what is done with their words, so few files are dealt out first;
    tables of many files are never moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = rows._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return rows.repartition(2 * cores, key) if few else rows


def token_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, toks): one row a document, so neighbours need no shuffle."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return d.select("doc_id", "lang", "source", token_array(F.col("text")).alias("toks"))


def explode_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, pos, tok)."""
    return docs.select("doc_id", "lang", "source", F.posexplode("toks").alias("pos", "tok"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_tokens(token_docs(spark, sf_dir))


def neighbours(arr: Column, step: int = 1, names: tuple[str, str] = ("w1", "w2")) -> Column:
    """Pairs of entries ``step`` apart, as an array of structs: adjacency within a row, without a window."""
    n = F.size(arr)
    ends = F.when(n > step, F.sequence(F.lit(step), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.struct(F.get(arr, i - step).alias(names[0]), F.get(arr, i).alias(names[1])))


def fixed(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of ``df``, computed once a row: a generator keeps the optimizer from moving them into the lambdas above."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, freq): the reference vocabulary, from ``benchmark``."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.explode(token_array(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def reference_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, toks): the reference corpus that transition probabilities come from."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", token_array(F.col("text")).alias("toks"))


def reference_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w1, w2, c, p): bigrams of the reference corpus with their transition probability."""
    pairs = reference_docs(spark, sf_dir).select(F.explode(neighbours(F.col("toks"))).alias("b")).select("b.*")
    counts = pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("w1").agg(F.sum("c").alias("n"))
    return counts.join(total, "w1").select("w1", "w2", "c", (F.col("c") / F.col("n")).alias("p"))
