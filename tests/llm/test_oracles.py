"""The corpus queries with SQL give the rows DuckDB gives, on whole tables and on odd ones."""

import os

import duckdb
import pytest

from stratalex.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def both(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "conversations", "stamps"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    got = QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.select(cols).collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    got, want = both(spark, name, SF)
    assert len(got) > 20 and got == want


def test_odd_turns(spark, tmp_path):
    rows = [(1, 0, None, "x"), (1, 1, "user", None), (2, 0, "system", "a\\b<s>"), (2, 1, "user", "<role x>"), (2, 2, "assistant", "</role>\\<s>"), (3, 0, "to>ol", "<a>é"), (None, 0, "user", "q")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = both(spark, "op8_chat_format", str(tmp_path))
    assert got == want and len(got) == 5


def test_odd_documents(spark, tmp_path):
    a = " ".join(f"w{i % 17}" for i in range(60))
    rows = [(1, a), (2, "x " + a + " y"), (3, None), (4, ""), (5, a[:20]), (6, a.replace("w3 ", "w3 ")), (7, a.replace(" ", "\t\n"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, "op10_phrase_dedup", str(tmp_path))
    assert got == want and len(got) == 7
