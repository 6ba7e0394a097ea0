import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return bpe.Encoder(bpe.PrefixBpe(ranks)), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(enc, text):
    return memoryview(enc.encode(text)).cast("i").tolist() if text else []


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(both, text):
    assert ids(both[0], text) == both[1].encode_ordinary(text)


def test_odd_texts(both):
    r = random.Random(4)
    texts = ["a" * 5000, "ab" * 3000, "<|endoftext|>", " \t\n\r\x1c\x1d\x85 　 x", "'s've'x don't", "0123456789" * 50, "\x00\x0b\x0c  a"]
    texts += ["".join(r.choice("abeinrst ") for _ in range(400)) for _ in range(50)] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert ids(both[0], t) == both[1].encode_ordinary(t), t[:40]


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|>", "x"), (1, "Hello <|endoftext|>", "x"), (2, None, "x"), (3, "", "x"), (None, "é" * 3, "x")], "doc_id bigint, text string, ids string")
    got = sorted(map(tuple, bpe.encode(df).collect()), key=str)
    assert got[:2] == [(1, got[0][1])] * 2 and (2, []) in got and (3, []) in got and (None, got[-1][1]) in got
    assert bpe.encode(df.limit(0)).collect() == []
