"""Long words, repeated rows, null ids and rows dealt in other ways: BPE, packing and chats."""

import random
import time

import pytest
from tokenizers import Tokenizer

from stratalex.llm import bpe, chat, packing

KINDS = {"letters": "abcdefghijklmnopqrstuvwxyz", "few": "ab", "one": "a", "signs": "-=+*", "digits": "0123456789", "wide": "".join(map(chr, range(0x4E00, 0x4E80)))}


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_long_words_are_those_of_the_library(library, kind):
    rng, own = random.Random(kind), bpe.codec(bpe.default_vocabulary())
    for size in (bpe.LONG - 1, bpe.LONG + 1, 5000, 20_001):
        text = "".join(rng.choices(KINDS[kind], k=size))
        ids = own.encode([text])[0]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_a_very_long_word_is_quick():
    text = "".join(random.Random(1).choices(KINDS["letters"], k=400_000))
    own = bpe.codec(bpe.default_vocabulary())
    began = time.time()
    ids = own.encode([text])[0]
    assert own.decode(ids) == text and time.time() - began < 40


def test_bpe_of_null_ids_and_repeated_rows(spark, library):
    rows = [(None, "hello there"), (1, "hello there"), (1, "hello there"), (2, None), (3, ""), (None, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as ids", "1 as n_tokens")
    got = sorted((tuple(r) for r in bpe.encode_documents(docs).collect()), key=str)
    assert got == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)


def test_bins_do_not_follow_how_rows_came(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a b c", "A b  c", "d " * rng.randint(0, 30), None, ""]), rng.choice([None, "s", "t"])) for _ in range(400)]
    rows += [(7, "same row", "s")] * 50 + [(None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as bin", "0 as piece")
    packed = [sorted(map(str, packing.pack(docs.repartition(n), capacity=40, per_source=2, block_rows=60).collect())) for n in (1, 3, 7)]
    assert packed[0] == packed[1] == packed[2] and len(packed[0]) >= len(rows)
    words = sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(r.length for r in packing.pack(docs, capacity=40, per_source=2, block_rows=60).collect()) == words
    assert sum(r.doc_id is None for r in packing.pack(docs, capacity=40).collect()) == sum(r[0] is None for r in rows)


def test_long_chats(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k} </s>" * (1 + k % 3)) for k in range(5000)]
    turns += [(2, 0, "user", "[INST]" * 200_000), (2, 1, "assistant", "é" * 1_000_000)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(rows)).collect()}
    assert (got[1].n_turns, got[2].n_turns) == (5000, 2)
    assert got[1].loss_chars == sum(len(t) for _, _, role, t in turns[:5000] if role == "assistant") and got[2].loss_chars == 1_000_000
