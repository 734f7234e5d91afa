import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from residua.llm import sentencepieces as m
from residua.llm.op6 import model_path
from residua.llm.sentencepieces import Vocabulary, roundtrip
from tests.llm import brute


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return Vocabulary.read(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())


def agree(both, text):
    v, sp = both
    ids = sp.encode(text, add_eos=True)
    assert v.encode(text) == ids
    assert v.decode(ids).decode() == sp.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aabbcdetinx  ▁\n\t.é漢😀0123\x00<s>/")), max_size=80))
def test_like_the_library(both, text):
    agree(both, text)


def test_long_and_strange_texts(both):
    rng = random.Random(4)
    for text in ("", " ", "   ", "▁", "</s>", "a" * 5000, "ab" * 3000, "".join(rng.choice("aeinst") for _ in range(20_000)), " " * 3000 + "x", "漢字" * 2000):
        agree(both, text)


def test_memory_is_bounded(both, monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 5)
    v = Vocabulary.read(model_path())
    for k in range(20):
        assert v.encode(f"one two three {k}") == both[1].encode(f"one two three {k}", add_eos=True)
    assert len(v.memory) <= 10


def test_operator(spark, both):
    texts = [None, "", "Hello world", "Hello world", "x" * 3000, " y "]
    docs = spark.createDataFrame([(k // 2, t, 1) for k, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in roundtrip(docs, both[0]).collect())
    ids = [both[1].encode(t or "", add_eos=True) for t in texts]
    assert got == sorted((k // 2, len(i), brute.sha(" ".join(map(str, i))), brute.sha(both[1].decode(i))) for k, i in enumerate(ids))
    assert [r["token_ids"] for r in roundtrip(docs.filter("doc_id = 1"), both[0], ids=True).collect()] == ids[2:4]
    assert roundtrip(docs.limit(0), both[0]).count() == 0


def test_very_long_words(both):
    rng = random.Random(8)
    for text in (" " * 1_000_000, "the" * 300_000, "a" * 300_000, "".join(rng.choice("acgt=") for _ in range(200_000)), "inging" * 20_000):
        began = time.time()
        agree(both, text)
        assert time.time() - began < 20  # the library's own time and decoding among it
    assert sum(map(len, both[0].memory)) < 2_000_000
    both[0].learn({"x"})
    assert max(map(len, both[0].memory)) <= m.LONG_WORD and both[0].chars <= m.REMEMBERED_CHARS


@pytest.mark.parametrize("slow", [-1, m.SLOW, 2.0])  # the queue as soon as possible, if need be, never
def test_long_words_like_the_library(both, monkeypatch, slow):
    monkeypatch.setattr(m, "SLOW", slow)
    rng = random.Random(5)
    pool = [p for p in both[0].ids if len(p) < 7]
    for _ in range(60):
        unit = rng.choice(["ab", "aeinst=-", "acgt", [" ", "  ", "in", "the", " " * 40], [rng.choice(pool).replace("▁", "") for _ in range(4)]])
        word = [rng.choice(unit) for _ in range(rng.choice([300, 900]))]
        agree(both, "".join(word if rng.random() < 0.5 else word[: rng.randint(1, 6)] * 200))
