import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import tokens as T

ODD = ["", " ", "it's 's's 'S don't  we'll\n\n 've x'rex''re '' 's", "a  b\n c\t\td   ", "　 x y \x1c z \x85", "'", "x'", "'l", "ab'll'", "a" * 3000, "é́ ١٢ Ⅷ½ ǅ ʰ 日本語 🙂🙂 <|endoftext|> \0 ﻿", "\n" * 500, " " * 70 + "x"]


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts):
    return [ids for ids, _ in T.Bpe.load().encode(texts)]


def test_odd_texts(theirs):
    assert ours(ODD) == theirs(ODD)
    assert ours([None]) == [[]]


@given(st.lists(st.text(st.sampled_from(" \n\t'slltrevmdDX1½é日🙂.,-　\x85\x1c\0"), max_size=80), max_size=12))
@settings(max_examples=150, deadline=None)
def test_random_texts(texts):
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert ours(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_has_its_class(theirs):
    rng = random.Random(1)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng.shuffle(points)
    texts = ["x" + "1a ".join(points[i : i + 200]) for i in range(0, 60_000, 200)]
    assert ours(texts) == theirs(texts)


def test_pieces_and_offsets_rebuild_the_text():
    for text in ODD:
        (words, offsets), = T.pieces([text])
        assert "".join(words) == text and all(text[o : o + len(w)] == w for o, w in zip(offsets.tolist(), words))


def test_texts_of_a_batch_do_not_touch(theirs):
    texts = ["a", "", "'s", " ", "b", "x" * 600_000, "'ll"]
    assert ours(texts) == theirs(texts)


def test_round_trip():
    b = T.Bpe.load()
    for text in ODD:
        assert b.decode(ours([text])[0]) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, "it's", "x"), (2, None, "x"), (3, "", "x"), (1, "it's", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"], r["offsets"]) for r in T.encoded(df).collect())
    assert got == [(1, [270, 338], [0, 2]), (1, [270, 338], [0, 2]), (2, [], []), (3, [], [])]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in T.token_counts(df, ["doc_id"]).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert T.encoded(df.limit(0)).count() == 0
