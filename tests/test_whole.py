"""Queries that once left out candidates: rows of their SQL where a skeleton has more words than were looked at."""

import duckdb
import pytest

from stratalex.plans.catalog import ORACLES, QUERIES

#: Queries over all words of a skeleton.
WHOLE = ["mask_solver_pass", "both_direction_words", "consensus_apply", "consensus_mapping", "consensus_relaxed", "forward_significance", "mapping_cardinality", "reverse_significance"]


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A folder whose dictionary has twenty words of one skeleton; the words around a token tell which one it is."""
    return crowd(tmp_path_factory.mktemp("crowded"), "nat")


def crowd(at, word):
    others = " ".join(f"n{a}t{b}" for a in "aeiou" for b in ("", "a", "e", "i") if f"n{a}t{b}" != word)
    con = duckdb.connect()
    con.execute(f"copy (select i as item_id, 'alpha {word} ohm kal' as text from range(3) t(i) union all select 3, '{others}') to '{at}/benchmark.parquet'")
    con.execute(f"copy (select i as doc_id, 'la' as lang, 's' as source, 'alpha nyyt ohm kyyl' as text from range(9) t(i)) to '{at}/documents.parquet'")
    return str(at)


@pytest.mark.parametrize("name", WHOLE)
def test_no_skeleton_has_too_many_words(spark, crowded, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{crowded}/{t}.parquet'")
    got = QUERIES[name](spark, crowded)
    cols = sorted(got.columns)
    have = sorted(map(tuple, got.select(cols).collect()), key=str)
    assert have == sorted(con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall(), key=str)
    assert any(FOUND[name].items() <= dict(zip(cols, r)).items() for r in have)


#: A part of a row that is there only if the crowded skeleton is read.
FOUND = {
    "mask_solver_pass": {"solved": 2, "types": 2, "first_word": "kal"},
    "both_direction_words": {"word": "nat"},
    "consensus_apply": {"lang": "la", "solved": 18},
    "consensus_mapping": {"skel": "N-T", "word": "nat", "c": 9, "total": 9},
    "consensus_relaxed": {"skel": "N-T", "word": "nat", "c": 9, "total": 9},
    "forward_significance": {"word": "nat", "k": 9, "m": 9, "n": 20},
    "mapping_cardinality": {"kind": "1:1", "mappings": 2, "total": 18},
    "reverse_significance": {"word": "nat", "k": 9, "m": 9, "n": 2},
}


def test_passes_look_at_all_words_of_a_skeleton(spark, tmp_path):
    got = {r["step"]: (r["n"], r["words"]) for r in QUERIES["mask_solver_passes"](spark, crowd(tmp_path, "nata")).collect()}
    # the word of the crowded skeleton and the one behind it, in each of nine documents
    assert got == {0: (18, 2), 1: (18, 2)}
