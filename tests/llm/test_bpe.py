"""The transducer against other implementations, and round trips."""

from __future__ import annotations

import random

import pytest

from corpusmith.llm.bpe import Encoder, StreamingDecoder, Transducer, count_tokens, encode_texts, vocabulary

pytest.importorskip("public_tokenizers")
SPECIAL = ["", "a", " ", "\n\n  x", "<|endoftext|>", "naïve café", "中文句子。", "🚀👩‍👩‍👧", "e\u0301", "\u200b", "a" * 3000, "ab" * 2000, "=" * 500, " " * 700, "don't I'LL", "x\r\ny\t\tz", "\x00\x01"]


@pytest.fixture(scope="module")
def own():
    return Encoder()


def test_equals_the_library(own):
    tiktoken = pytest.importorskip("tiktoken")
    ids, pattern = vocabulary()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
    r = random.Random(3)
    texts = SPECIAL + ["".join(r.choice("abcdeéèthing ,.\n\t  中文🚀́INGing09") for _ in range(r.randint(1, 80))) for _ in range(600)]
    for t in texts:
        assert own.encode(t) == other.encode_ordinary(t), t


def test_null_and_small_caches(own, monkeypatch):
    assert own.encode(None) == [] == own.encode("")
    monkeypatch.setattr("corpusmith.llm.bpe.STATES_KEPT", 5)
    monkeypatch.setattr("corpusmith.llm.bpe.WORDS_KEPT", 3)
    fresh = Encoder()
    assert [fresh.encode(t) for t in SPECIAL] == [own.encode(t) for t in SPECIAL]


def test_transducer_on_a_small_vocabulary():
    ids = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"aa": 260}
    t = Transducer(ids)
    r = random.Random(1)
    for _ in range(500):
        word = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 12)))
        assert list(t.encode(word)) == t.merged(word)


def test_round_trip_in_pieces(own):
    for text in SPECIAL:
        d = StreamingDecoder()
        assert "".join(d.feed([i]) for i in own.encode(text)) + d.close() == text
    ids = {bytes([b]): b for b in range(256)}
    for data in [b"\xff\xfe", b"\xe4\xb8", b"\xc3(", b"\xf0\x9f\x9a", b"\xed\xa0\x80", b"ok\xc0\xafz", b"\xf4\x90\x80\x80"]:
        d = StreamingDecoder(ids=ids)
        assert d.feed(data) + d.close() == data.decode("utf-8", "replace")


def test_frames(spark, own):
    rows = [(1, "some text"), (2, None), (3, ""), (1, "some text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids")
    got = sorted((r.doc_id, r.ids) for r in encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, own.encode("some text"))] * 2 + [(2, []), (3, [])]
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df, "doc_id", "text").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
