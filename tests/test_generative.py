"""Models through SQL: one registered here is generated, profiled and judged; errors when a query is analysed."""

import pytest
from pyspark.sql import functions as F

from stratalex.operators import generative as ge


def test_a_model_of_one_s_own_through_sql(spark):
    class Two(ge.GenerativeModel):
        """Two words in turn."""

        GRID = {"first": ("ab", "ba"), "second": ("cd",)}

        def words(self, rng, n):
            return [self.params["first"] if i % 2 == 0 else self.params["second"] for i in range(n)]

        def critical(self, profile):
            return profile["ttr"] < 0.1

    ge.register_model("two", Two)
    try:
        ge.register_sql(spark)
        made = spark.sql("SELECT s.id, g.pos, g.word FROM range(3) s, LATERAL generated('two', '{\"first\": \"xy\"}', s.id, 40) g")
        rows = made.collect()
        assert len(rows) == 120 and {r.word for r in rows} == {"xy", "cd"} and all(r.word == ("xy" if r.pos % 2 == 0 else "cd") for r in rows)
        grid = spark.sql("SELECT params FROM model_grid('two')").collect()
        assert sorted(r.params for r in grid) == ['{"first": "ab", "second": "cd"}', '{"first": "ba", "second": "cd"}']
        texts = made.groupBy(F.lit("two").alias("run"), "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("toks"))
        ge.profiles(texts).createOrReplaceTempView("profiles")
        row = spark.sql("SELECT p.*, s.distance, s.near FROM profiles p, LATERAL quick_score(p.h2, p.ttr, p.exponent, p.h2, p.ttr, p.exponent) s").first()
        assert row.near and row.distance == 0 and row.words == 120 and row.ttr == pytest.approx(2 / 120)
        assert ge.passes("two", row)
        far = spark.sql("SELECT s.* FROM profiles p, LATERAL quick_score(p.h2 + 1.0D, p.ttr, p.exponent, p.h2, p.ttr, p.exponent) s").first()
        assert not far.near and far.distance == pytest.approx(3**0.5)
    finally:
        del ge.MODELS["two"]


def test_the_models_that_are_there(spark):
    ge.register_sql(spark)
    for name, model in ge.MODELS.items():
        grid = model.grid()
        assert len(grid) == len({str(g) for g in grid}) > 1
        a, b, c = (spark.sql(f"SELECT word FROM generated('{name}', '', {seed}, 200) ORDER BY pos").collect() for seed in (1, 1, 2))
        assert a == b != c and len(a) == 200 and all(r.word.isalpha() for r in a)


def test_errors_when_analysed(spark):
    ge.register_sql(spark)
    for bad in ("generated('none', '', 1, 5)", "generated('slots', '{\"no\": 1}', 1, 5)", "ngrams('a b', 0)"):
        with pytest.raises(Exception, match="no model|no such parameters|ngrams needs"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    with pytest.raises(ValueError):
        ge.register_model("a b", ge.Slots)


def test_ngrams_have_as_many_columns_as_asked(spark):
    ge.register_sql(spark)
    got = spark.sql("SELECT g.* FROM VALUES ('a b c d'), (NULL), ('x') t(text), LATERAL ngrams(t.text, 3) g")
    assert got.columns == ["pos", "w1", "w2", "w3"] and [tuple(r) for r in got.collect()] == [(0, "a", "b", "c"), (1, "b", "c", "d")]
