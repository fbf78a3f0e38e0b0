"""The pipeline's stages, each judged on its own input."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        from stratalex.session import materialize

        out.append(materialize(stage(spark, out[-1], SF), "test")[0])
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "passages", "packed"]
    for d in stages[1:5]:
        assert d.schema == stages[0].schema


def test_clean_documents_stay_and_junk_goes(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"] for r in stages[0].select("doc_id").collect()}
    after = {r["doc_id"] for r in stages[2].select("doc_id").collect()}
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in good) >= 0.99 * len(good)
    assert sum(d not in after for d in bad) >= 0.6 * len(bad)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_copies_go_and_one_of_each_group_stays(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].select("doc_id", "text").collect()}
    after = {r["doc_id"] for r in stages[3].select("doc_id").collect()}
    sets = {d: shingles(t) for d, t in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    kept = sorted(after)
    texts = [before[d] for d in kept]
    assert len(set(texts)) == len(texts)
    for d in before.keys() - after:
        assert max(like(d, k) for k in before if k != d) >= 0.8
    # what stays has no smaller document linked to it by a chain of 0.8: brute force over all pairs
    order = sorted(before)
    root = {d: d for d in order}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, d in enumerate(order):
        for k in order[:i]:
            if sets[d] and sets[k] and 0.7 <= len(sets[d]) / len(sets[k]) <= 1.43 and like(d, k) >= 0.8:
                a, b = sorted((find(d), find(k)))
                root[b] = a
    assert after == {find(d) for d in order}


def test_no_window_is_left_that_a_smaller_document_started(stages):
    src = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    out = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    first = {}
    for d in sorted(src):
        w = re.findall(r"[^\x20\x09-\x0D]+", src[d])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t in src.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = [x for i, x in enumerate(w) if i not in gone]
        assert (d in out) == bool(kept)
        if kept:
            assert out[d].split() == kept


def test_packed_words_are_all_there(stages):
    sizes = {r["doc_id"]: len(r["text"].encode().split()) for r in stages[4].collect()}
    packed = {}
    for r in stages[5].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == sizes


def test_stages_take_odd_tables(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "x" * 100_000, "en", None, 100_000), (-3, "a b " * 20_000, None, "s", 80_000)]
    docs = source.unionByName(spark.createDataFrame(rows, odd)).unionByName(source)
    for name in ("_language", "_dedup", "_quality", "row", "block", "perplexity", "keep"):
        docs = docs.withColumn(name, docs["n_chars"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0 and nothing.columns == out.columns
        if name != "packed":
            assert out.columns == docs.columns
            assert out.count() > 0
        else:
            assert out.count() >= docs.count()
