"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from stratalex.functions import text as ft


def values(spark, words, f):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", f(F.col("w")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_skeleton(spark):
    assert values(spark, ["coquere", "papaver", "aqua", "et", "calida", "aeio", ""], ft.skeleton) == ["K-R", "P-R", "K", "T", "K-L-T", "", ""]


def test_vowel_skeleton(spark):
    assert values(spark, ["coquere", "tt", "tat"], ft.vowel_skeleton) == ["K-V-K-V-V-R-V", "T", "T-V-T"]


def test_cipher_skeleton_takes_pairs_first_and_keeps_repeats(spark):
    assert values(spark, ["chol", "shin", "ckk", "tt", "ooo"], ft.cipher_skeleton) == ["K-L", "S-N", "K-K", "T-T", ""]


def test_pattern_signature(spark):
    assert values(spark, ["abcabc", "aabbcc", "chotchol", "x"], ft.pattern_signature) == ["ABCABC", "AABBCC", "ABCDABCE", "A"]


def test_stem_and_parse(spark):
    assert values(spark, ["herbarum", "aqua", "et", "rosa"], ft.stem) == ["herb", "aqu", "et", "ros"]
    assert values(spark, ["conficere", "in", "redde"], ft.parse_prefix) == ["con", "", "re"]


def test_pos_tag(spark):
    assert values(spark, ["in", "et", "non", "hic", "facit", "bonus", "rex", ""], ft.pos_tag) == ["PREP", "CONJ", "ADV", "DET", "VERB", "ADJ", "NOUN", "OTHER"]


def test_suffix_tag(spark):
    assert values(spark, ["daiin", "ady", "y", "okal"], ft.suffix_tag) == ["VERB_3P", "NOUN_FEM", "UNK", "NOUN"]


def test_syllables(spark):
    assert values(spark, ["herba", "str", "rosarum"], ft.syllables) == [["he", "rba"], ["str"], ["ro", "sa", "rum"]]


@pytest.mark.parametrize(("stem", "suffix", "form"), [("ros", "am", "rosam"), ("rose", "es", "roses"), ("rosa", "a", "rosa"), ("ami", "is", "amis"), ("leg", "t", "legit"), ("ama", "t", "amat")])
def test_synthesize(spark, stem, suffix, form):
    df = spark.createDataFrame([(stem, suffix)], "a string, b string")
    assert df.select(ft.synthesize(F.col("a"), F.col("b"))).first()[0] == form


def test_rewrite_longest_first(spark):
    assert values(spark, ["cthy", "qokeedy"], lambda w: ft.rewrite(w, ft.SIGN_GROUPS)) == ["Uy", "QkEdy"]
