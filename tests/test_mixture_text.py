import math
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import mixture, planning
from millrace.operators.shards import role_spans, role_words
from millrace.plans import made

SHARES = {"general_web": 0.42, "code": 0.16, "math_science": 0.14, "indic": 0.12, "reasoning": 0.1, "agentic": 0.06}


def test_apportion_sums_up_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("g", k, v) for k, v in SHARES.items()] + [("h", "b", 1.0), ("h", "a", 1.0), ("z", "a", 0.0), ("n", "a", None), ("n", "b", -1.0)], "k string, lane string, weight double")
    got = {(r["k"], r["lane"]): r["units"] for r in mixture.apportion(df, ["k"], 7).collect()}
    assert sum(n for (k, _), n in got.items() if k == "g") == 7
    assert (got["h", "a"], got["h", "b"]) == (4, 3) and got["z", "a"] == 0 and got["n", "a"] == got["n", "b"] == 0


def floored(spark, counts, floors, total, supply=None):
    rows = [("g", k, n, floors.get(k), (supply or {}).get(k)) for k, n in counts.items()]
    df = spark.createDataFrame(rows, "k string, lane string, units int, floor double, available long")
    return {r["lane"]: r for r in mixture.enforce_floors(df, ["k"], total, 3).collect()}


def test_floors_take_from_the_largest_until_it_is_empty(spark):
    counts = {"general_web": 4, "code": 1, "math_science": 1, "indic": 1, "reasoning": 1, "agentic": 0}
    after = floored(spark, counts, {"indic": 0.1, "agentic": 0.05, "reasoning": 0.05}, 8)
    assert {k: r["units"] for k, r in after.items()} == {**counts, "general_web": 3, "agentic": 1}
    assert (after["agentic"]["required"], after["agentic"]["added"], after["agentic"]["donors"]) == (1, 1, ["general_web", "code", "math_science"])
    assert all(r["added"] == 0 and r["donors"] == [] for k, r in after.items() if k != "agentic")
    assert {k: r["units"] for k, r in floored(spark, {"a": 3, "b": 2, "c": 0}, {"c": 0.8}, 5).items()} == {"a": 0, "b": 1, "c": 4}
    assert floored(spark, {"a": 5, "c": 0}, {"c": 0.5}, 5, {"c": 0})["a"]["units"] == 5
    # all have floors: those give that stay at theirs; equal ones by name
    assert {k: r["units"] for k, r in floored(spark, {"a": 3, "b": 3, "c": 0}, {"a": 0.2, "b": 0.2, "c": 0.3}, 6).items()} == {"a": 1, "b": 3, "c": 2}
    # nobody can give; null units and not-a-number floors
    assert floored(spark, {"a": 1, "b": None}, {"a": 1.0, "b": 1.0}, 1)["b"]["added"] == 0
    assert floored(spark, {"a": 1, "b": 0}, {"b": float("nan")}, 1)["b"]["required"] == 0


def test_empty_lanes_hand_their_units_on(spark):
    m = spark.createDataFrame([("ground-layer", "a", 0.5, None), ("ground-layer", "b", 0.3, None), ("ground-layer", "c", 0.2, 0.2)], "stage string, lane string, target_share double, protected_floor double")
    for have, want in (({"a": 9, "b": 9, "c": 9}, (5, 3, 2)), ({"a": 9, "b": 9}, (6, 4, 0)), ({"a": 9}, (10, 0, 0)), ({}, (0, 0, 0))):
        supply = spark.createDataFrame(list(have.items()), "lane string, available long")
        got = {r["lane"]: r["sequences"] for r in mixture.compile_schedule(m, supply, 10, 1, 0).collect()}
        assert tuple(got[x] for x in "abc") == want


def test_interleave_takes_lanes_in_turn(spark):
    rows = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "a", 3), ("s", "c", 4), ("s", "b", 5), ("s", "b", 6)], "k string, lane string, seq long")
    got = [(r["lane"], r["seq"]) for r in planning.interleaved(rows, ["k"], "seq").orderBy("pos").collect()]
    assert got == [("a", 1), ("b", 5), ("c", 4), ("a", 2), ("b", 6), ("a", 3)]


def test_shuffle_is_a_permutation_that_the_seed_decides(spark):
    s = spark.createDataFrame([("a", f"x{i}") for i in range(50)] * 2, "lane string, sample_id string")
    one = {r["sample_id"]: r["place"] for r in planning.shuffle_index(s, "1").collect()}
    assert sorted(one.values()) == list(range(50))
    assert one == {r["sample_id"]: r["place"] for r in planning.shuffle_index(s.repartition(7), "1").collect()}
    assert one != {r["sample_id"]: r["place"] for r in planning.shuffle_index(s, "2").collect()}


def test_normalize_is_idempotent_and_keeps_joiners(spark):
    raw = ["a\r\nb\rc", "﻿x­​y  \n\n\n\nz ", "é", "क्‍ष", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, text string")
    once = [r["n"] for r in df.select("i", text.normalize().alias("n")).orderBy("i").collect()]
    assert once == ["a\nb\nc\n", "xy\n\nz\n", "é\n", "क्‍ष\n", "\n", None]
    again = spark.createDataFrame(list(enumerate(once)), "i int, text string").select("i", text.normalize().alias("n")).orderBy("i").collect()
    assert [r["n"] for r in again] == once


def test_grams_scripts_and_canaries(spark):
    t = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(t,), ("two words",), ("",), ("EVAL-CANARY-ab12-x EVAL-CANARY-ab12-x",)], "text string")
    got = df.select(text.grams().alias("g"), text.script_of().alias("s"), text.canaries().alias("c")).collect()
    assert got[0]["g"] == ["one two three four five six seven eight", "two three four five six seven eight nine"]
    assert got[1]["g"] == ["two words"] and got[2]["g"] == [] and got[2]["s"] == "Zyyy" and got[3]["c"] == ["EVAL-CANARY-ab12-x"]


def test_role_spans(spark):
    docs = spark.createDataFrame([(1, "lead\n@user:  hi  \nthere\n@answer: yes\n@think:\n"), (2, " plain\n\n\ntext "), (3, None), (4, ""), (5, "not @user: a marker")], "doc_id long, text string")
    got = [(r["doc_id"], r["span_no"], r["role"], r["graded"], r["text"]) for r in role_spans(docs).orderBy("doc_id", "span_no").collect()]
    assert got == [(1, 0, "user", False, "hi\nthere"), (1, 1, "answer", True, "yes"), (2, 0, "text", True, "plain\n\n\ntext"), (4, 0, "text", True, ""), (5, 0, "text", True, "not @user: a marker")]


ODD = [
    (1, "a", "lead\n@user:  hi  \nthere\n@answer: yes hi\n@think:\n@tool_call:x_1@think: y\n@tool_result: z"), (2, "a", " Plain\n\n\nİx text "), (3, "a", None), (4, "b", ""), (5, "b", "not @user: a marker"),
    (6, "c", "@user: only asked"), (7, None, "@answer:think think"), (8, "b", "\n@think: a\r\n@answer: a\n @user: a"), (None, "a", "@answer: hi"), (9, "d", "@answer:@answer: a\n\n"), (10, "d", "lead only\n"),
]


def test_role_words_are_those_of_the_spans(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, lane string, text string")
    want = {}
    for words, at in ((docs.select("lane", F.explode(text.words()).alias("w")), 0), (role_spans(docs).where("graded").select("doc_id", F.explode(text.words()).alias("w")).join(docs, "doc_id").select("lane", "w"), 1)):
        for r in words.collect():
            want.setdefault((r["lane"], r["w"]), [0, 0])[at] += 1
    got = [(r["lane"], r["word"], r["all"], r["n"]) for r in role_words(docs).collect()]
    assert sorted(got, key=repr) == sorted([(*k, *v) for k, v in want.items()], key=repr)
    assert ("a", "hi", 3, 1) in got and (None, "think", 2, 2) in got and ("c", "asked", 1, 0) in got and ("a", "ix", 1, 1) in got


def shuffled(spark, run):
    """What run gives, and the rows written to shuffles meanwhile."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    out = run()
    return out, sum(n for k, n in written().items() if k not in before)


def test_masked_loss_shuffles_counts_not_words(spark, tmp_path):
    body = [f"@user: w1 w2\n@answer: {' '.join(f'w{(i * j) % 50}' for j in range(1000))}" for i in range(1, 61)]
    rows = [(i, f"lane{i % 3}", t) for i, t in enumerate(body)] + [(100, "asked", "@user: w1")]
    spark.createDataFrame(rows, "doc_id long, lane string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        got, n = shuffled(spark, lambda: {r["lane"]: (r["targets"], r["loss"]) for r in made.masked_loss(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    every = Counter(w for _, _, t in rows for w in re.findall(r"\w+", t))
    for k in range(3):
        own = [w for _, lane, t in rows if lane == f"lane{k}" for w in re.findall(r"\w+", t.split("@answer:")[1])]
        assert got[f"lane{k}"][0] == len(own) == 20_000
        assert abs(got[f"lane{k}"][1] - sum(-math.log(every[w] / every.total()) for w in own) / len(own)) < 2e-6
    # a lane without graded words isn't there; 60,000 words stand in the texts
    assert len(got) == 3 and n < 6_000


def test_selection_rules(spark):
    rows = [("b", 1, "code", f"c{i}", s, m, 2) for i, (s, m) in enumerate([(0.9, False), (0.5, True), (0.5, True), (0.1, True), (float("nan"), True)])] + [("b", 1, "code", "c1", 0.4, True, 2)]
    got = {(r["candidate_id"], r["reason"]): r["status"] for r in planning.select(spark.createDataFrame(rows, "branch_id string, step int, lane string, candidate_id string, score double, matches boolean, quota int"), ["branch_id", "step", "lane"], ("indic",)).collect()}
    assert got == {("c1", "merit"): "accepted", ("c2", "merit"): "accepted", ("c0", "stage_mismatch"): "rejected", ("c3", "below_threshold"): "deferred", ("c4", "below_threshold"): "deferred", ("c1", "duplicate"): "rejected"}
    assert F.lit(1) is not None
