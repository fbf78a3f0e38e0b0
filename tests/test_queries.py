"""Every query with SQL gives the rows DuckDB gives, on the smallest data."""

import os

import duckdb
import pytest

from stratalex.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    one = lambda v: "~" if v is None or v != v else (round(float(v), 5) if isinstance(v, float) else v)
    return sorted([tuple(map(one, r)) for r in rows], key=str)


def test_each_query_has_one_name_and_most_have_sql():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    have = [tuple(r) for r in got.select(cols).collect()]
    a, b = plain(have), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or (isinstance(p, float) and abs(p - q) < 2e-5) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", ["assignment_letters", "markov_structure", "topic_factors", "word_clusters", "context_automaton", "automaton_likeness", "syllable_beam", "annealed_mapping", "grammar_text", "model_scores", "beam_decode", "budgeted_decode", "markov_text", "grammar_search", "shuffle_null_pvalue", "label_clusters", "mask_solver_passes", "rank_pairs_unused_first", "choice_carrier", "refine_loop"])
def test_the_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_scan_reads_only_what_is_asked(spark):
    plan = QUERIES["page_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "text" not in plan.split("ReadSchema")[1]


def test_settings_of_a_sweep_are_those_of_runs_of_their_own(spark):
    """All settings at once, and one by one through the whole solver."""
    from pyspark.sql import functions as F

    from stratalex.operators import matching as m
    from stratalex.plans import matching, solver
    from stratalex.session import Tables

    swept = {r["setting"]: r["found"] for r in QUERIES["solver_sweep"](spark, SF).collect()}
    tables = Tables(spark)
    parts = solver._prepared(spark, SF, tables)
    open_ = tables.put(m.nearest_resolved(matching._resolved(spark, SF)).where("word is null").drop("word"), "open")
    for name, ratio, near in (("confidence_ratio=2", 2.0, 0.6), ("near_factor=0.3", 5.0, 0.3)):
        one = spark.createDataFrame([("x", ratio, near)], "setting string, ratio double, near double")
        assert solver.solve_pass(open_, *parts, one).where("word is not null").count() == swept[name]
    plain = solver.solve_pass(open_, *parts).where(F.col("word").isNotNull()).count()
    assert plain == swept["confidence_ratio=5"] == swept["near_factor=0.6"] and len(set(swept.values())) > 1
    tables.drop()
