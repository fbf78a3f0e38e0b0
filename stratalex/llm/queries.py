"""Queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import (
    bpe,
    cap_filters,
    chat,
    edit_sketch,
    fill_middle,
    kneser_ney,
    language_id,
    license_scan,
    oracles,
    packing,
    phrase_dedup,
    simhash_golay,
    stages,
    stamps,
    suffix_dedup,
)
from stratalex.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_sketch.compare_versions(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicates(_table(spark, sf_dir, "documents"), bits=4, shingle=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(bpe.encode_documents(_table(spark, sf_dir, "documents")))


#: What both turns of conversation -7 say.
SAID = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select(
        "doc_id", language_id.held_out().alias("held_out"), F.col("_language.lang").alias("lang_pred"), "_language.score", "_language.rejected"
    )


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrase_dedup.kept_words_digest(phrase_dedup.remove_repeats(docs))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_middle.digests(fill_middle.transform(docs, seed=1))


def op12_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stamps.normalise(_table(spark, sf_dir, "stamps"))
    return found.select("stamp_id", "_stamp.utc_us", "_stamp.rule", "_stamp.ambiguous")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.kept_digest(suffix_dedup.remove_recurring(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_edit_sketches,
        op2_license_scan,
        op3_simhash_golay,
        op4_best_fit_packing,
        op5_kneser_ney_quality,
        op6_cap_filters,
        op7_bpe_round_trip,
        op8_chat_format,
        op9_language_id,
        op10_phrase_dedup,
        op11_fill_middle,
        op12_stamps,
        op13_suffix_dedup,
        pipeline,
    )
}

ORACLES: dict[str, str] = {"op8_chat_format": oracles.chat_format(SAID), "op10_phrase_dedup": oracles.PHRASE_DEDUP, "op11_fill_middle": oracles.FILL_MIDDLE, "op12_stamps": oracles.STAMPS, "op13_suffix_dedup": oracles.SUFFIX_DEDUP}
if stages.ORACLE_SQL:
    ORACLES["pipeline"] = stages.ORACLE_SQL
