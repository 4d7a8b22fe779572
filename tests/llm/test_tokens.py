import random

import pytest

from curvelake.llm.tokens import VOCABULARY, Encoder, encode_corpus

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["Hello world, it's 42!", "  \n\n x\t\ty ", "<|endoftext|> is text", "a" * 3000, "ab" * 900, "é" * 400 + " naïve Übermaß", "🙂🙂 ok", " " * 2000, "I'LL we've 'S", "\x1c a\x1f b", "x\r\n\r\ny", "\x85a b​ c", "0" * 700, "ΔG ≈ −kT·ln P"]


def test_same_as_the_library(library):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice(" abcdefgh'\n1290éß🙂.,<>|") for _ in range(rng.randrange(1, 500))) for _ in range(200)]
    e = Encoder()
    for t in texts:
        assert e.encode(t) == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_scan_and_heap_agree():
    e = Encoder()
    for t in TEXTS:
        for w in e.wide.findall(t):
            assert e.short(w.encode()) == e.long(w.encode())


def test_round_trip_and_empty_texts(spark):
    rows = [(1, "Some text.", "x"), (2, None, "x"), (3, "", "x"), (None, " ", "x"), (1, "Some text.", "x"), (5, "long " * 50_000, "x")]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    back = {v: k for k, v in Encoder().rank.items()}
    by = [(r["doc_id"], b"".join(back[i] for i in r["ids"]).decode()) for r in got.collect()]
    assert sorted(by, key=str) == sorted([(i, t or "") for i, t, _ in rows], key=str)


def test_no_documents(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
