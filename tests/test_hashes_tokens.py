import hashlib
import os
import random

import pytest
import regex
from pyspark.sql import functions as F

from millrace.functions import hashing, tokens


@pytest.mark.parametrize("width", [4, 16])
def test_spread_roots_are_those_of_the_whole_tree(spark, width):
    r = random.Random(width)
    rows, want = [], {}
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40):
        leaves = [hashlib.sha256(f"{n}:{i}".encode()).hexdigest() for i in range(n)]
        places = sorted(r.sample(range(10**9), n))
        rows += [(f"g{n}", p, d) for p, d in zip(places, leaves)]
        want[f"g{n}"] = (hashing.merkle_root(leaves), n)
    r.shuffle(rows)
    rows += [("none", 1, None), ("g1", 5, None)]
    got = hashing.merkle_roots(spark.createDataFrame(rows, "k string, o long, d string"), "k", "o", "d", width).collect()
    assert {x["k"]: (x["root"], x["leaves"]) for x in got} == want


TEXTS = ["It's we'll they'd 12 3½ a_b  c\n\n d\t", "नदी का 45 जल", "水位计 12,5! x", "", "  ", "a\xa0b c\u0085d", "don'T 'S 's", None]


def test_pretokens_against_the_pattern(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r["i"]: r["p"] for r in df.select("i", tokens.pretokens().alias("p")).collect()}
    assert got == {i: None if t is None else regex.findall(tokens.PATTERN, t) for i, t in enumerate(TEXTS)}


def test_counts_and_round_trip(spark):
    if not os.path.isdir(tokens.FOLDER):
        pytest.skip("no vocabularies")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r["i"]: r["tokens"] for r in tokens.token_counts(df, ["i"]).collect()}
    encode = tokens._encoding("byte_bpe_multi_50k", tokens.FOLDER).encode_ordinary
    for i, t in enumerate(TEXTS):
        ids = encode(t or "")
        assert got[i] == len(ids) and tokens.decode(ids) == (t or "")
    assert tokens.token_counts(df.where(F.lit(False)), ["i"]).count() == 0
