import random

from pyspark.sql import functions as F

from millrace.operators.joins import lookup_join, skew_join
from millrace.operators.windows import previous, running_max, running_sum


def test_joins_are_the_same_however_they_run(spark):
    r = random.Random(1)
    left = spark.createDataFrame([(r.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, v int")
    want = sorted(left.join(right, ["k"], "left").collect(), key=repr)
    for got in (lookup_join(left, right, ["k"]), lookup_join(left, right, ["k"], limit=0, salts=4), skew_join(left, right, "k"), skew_join(left, right, "k", hot_rows=50)):
        assert sorted(got.select("k", "i", "v").collect(), key=repr) == want


def test_running_sums_over_stretches(spark):
    r = random.Random(2)
    data = [(r.choice("aab"), i, r.choice([None, 1, 5])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, o long, v int")
    got = {(x["k"], x["o"]): x for x in running_max(running_sum(df, ["k"], ["o"], "v", "s", width=7), ["k"], ["o"], "v", "m", width=7).collect()}
    assert len(got) == len(data)
    for k in "ab":
        total, top = 0, None
        for _, o, v in sorted(x for x in data if x[0] == k):
            total += v or 0
            top = v if top is None else max(top, v or top)
            assert got[k, o]["s"] == total and got[k, o]["m"] == top


def test_previous_over_stretches(spark):
    df = spark.createDataFrame([("a", o, o * 10) for o in (1, 2, 9, 30, 31)], "k string, o long, v int")
    got = {x["o"]: x["prev_v"] for x in previous(df, ["k"], "o", ["v"], width=4).collect()}
    assert got == {1: None, 2: 10, 9: 20, 30: 90, 31: 300}
    assert previous(df.where(F.lit(False)), ["k"], "o", ["v"]).count() == 0
