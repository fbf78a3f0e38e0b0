"""The solver in the row."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalex.functions import text as ft
from stratalex.operators import solver as rows
from stratalex.plans import solver
from stratalex.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def planned(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, n=40):
    """(doc_id, toks) of some documents, and ids that are null or below 0."""
    docs = solver._docs(spark, SMALL).limit(n).collect()
    return [(None if i == 3 else -5 if i == 4 else r["doc_id"], r["toks"]) for i, r in enumerate(docs)]


def test_one_pass_moves_counts_alone(spark):
    """All open tokens once went through windows and three joins."""
    plan = planned(spark, "mask_solver_full")
    assert "MapInArrow" in plan and "Window" not in plan and "Join" not in plan


def test_settings_are_counted_in_the_row(spark):
    plan = planned(spark, "solver_sweep")
    assert "MapInArrow" in plan and "Window" not in plan and "Join" not in plan


def test_skeletons_and_classes_in_the_row_are_those_of_columns(spark):
    words = sorted({w for _, toks in documents(spark) for w in toks} | {"et", "aaa", "hicat", "quod", "omnis"})
    ref = solver._reference(spark, SMALL, None)
    want = spark.createDataFrame([(w,) for w in words], "w string").select("w", ft.skeleton(F.col("w")).alias("s"), ft.pos_tag(F.col("w")).alias("t")).collect()
    known = set(ref.words.to_pylist())
    for code, r in zip(ref.codes(pa.array([r["w"] for r in want])).tolist(), want):
        if r["w"] in known:
            assert ref.words[code].as_py() == r["w"]
        elif r["s"] in ref.skels:
            skel, kind = divmod(-2 - code, 4)
            assert ref.skels[skel] == r["s"] and kind == {"VERB": 1, "ADJ": 2, "NOUN": 3}.get(r["t"], 0)
        else:
            assert code == -1


def test_documents_of_any_cut_are_decided_alike(spark, monkeypatch):
    ref = solver._reference(spark, SMALL, 15)
    docs = documents(spark)
    batch = pa.record_batch([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.list_(pa.string()))], names=["doc_id", "toks"])

    def all_(most):
        out, first = [], 0
        monkeypatch.setattr(rows.cut, "__defaults__", (most,))
        for sizes, _, texts in rows.texts_of(ref, [batch]):
            at, [(kind, word)] = rows.decided(ref, texts)
            out += zip((at + first).tolist(), kind.tolist(), word.tolist())
            first += int(sizes.sum())
        return out

    whole = all_(1 << 19)
    assert whole == all_(1) == all_(700) and len(whole) > 300
    # a document without id has no field, so nothing of it is decided
    ends = np.cumsum([len(t) for _, t in docs])
    assert not [at for at, _, _ in whole if ends[2] <= at < ends[3]]
