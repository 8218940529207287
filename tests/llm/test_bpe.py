import random
from array import array

import pytest

from millrace.functions import tokens
from millrace.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


def ids(encoder, text):
    return array("i", encoder.encode(text)).tolist()


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def pair(request):
    return bpe.Encoder(bpe.read_ranks(request.param)), tokens._encoding(request.param, tokens.FOLDER)


CASES = ["a", " a", "a b", "  a\n\n b \t", "it's I'LL they've '", "<|endoftext|> x", "naïve café", "हिन्दी क्‍ष", "ไทยไม่มีช่องว่าง", "日本語。中文！", "👩‍🌾🏽", "\x1c\x1d a", " x\xa0y", "١٢٣ ½ Ⅷ", "x" * 128, "x" * 129, "ab" * 3000, "क्ष" * 200, "1" * 1000, " " * 500 + "z"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_library(pair, text):
    mine, theirs = pair
    assert ids(mine, text) == theirs.encode_ordinary(text)
    assert theirs.decode(ids(mine, text)) == text


def test_random_texts(pair):
    mine, theirs = pair
    r = random.Random(5)
    ranges = [(32, 127), (0, 40), (0x80, 0x600), (0x900, 0xD00), (0xE00, 0xE7F), (0x3000, 0x9FFF), (0x1F300, 0x1FAFF)]
    for _ in range(1500):
        text = "".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(80)))
        assert ids(mine, text) == theirs.encode_ordinary(text)


def test_both_merge_loops_agree(pair):
    mine, _ = pair
    r = random.Random(6)
    for _ in range(300):
        word = bytes(r.choice(b"abetin s\xe0\xa4\x95") for _ in range(r.randrange(2, 120)))
        assert mine._short(word) == mine._long(word)


def test_frames(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "hello world", "x"), (4, "x" * 50000, "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df).collect()]
    assert got[:4] == [(1, [31373, 995]), (2, []), (3, []), (1, [31373, 995])]
    counts = bpe.count_tokens(df, ["doc_id", "ids"]).collect()
    assert [r["tokens"] for r in counts] == [len(x[1]) for x in got]
    assert bpe.encode(df.where("doc_id < 0")).count() == 0
