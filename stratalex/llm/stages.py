"""Corpus preparation: quality, language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``, and further ones that ``docs`` may have, of any name.
Tables without rows go through all stages. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import kneser_ney, language_id, packing, phrase_dedup, simhash_golay
from stratalex.llm.common import drop_path, materialize
from stratalex.session import ship_package


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many signs as it takes to be no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text lies within their language's bounds; null and empty texts go."""
    ship_package(spark)
    return kneser_ney.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the column lang stays as it came. Texts without a letter go."""
    ship_package(spark)
    into = _free(docs, "_language")
    found = language_id.identify(docs, language_id.fit(docs), into=into)
    return found.where(~F.col(f"{into}.rejected")).select(*_own(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id. Rows without an id stay."""
    ship_package(spark)
    groups = simhash_golay.similar_documents(docs)
    go = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti").select(*_own(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has too; those with no word left go."""
    ship_package(spark)
    into = _free(docs, "_dedup")
    clean = phrase_dedup.remove_repeats(docs, into=into).where(F.col(f"{into}.n_removed") < F.col(f"{into}.n_words"))
    clean = clean.withColumn("text", F.col(f"{into}.kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*_own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all words of the documents in training sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("passages", passages),
    ("packed", packed),
]

#: The stages learn models and pack greedily, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return docs
