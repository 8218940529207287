import math
import random

import pytest

from millrace.llm import topn

SCHEMA = "g string, h int, id string, score double, _s string, note string"


def brute(rows, n):
    groups = {}
    for g, h, i, s, *_ in rows:
        if None not in (g, h) and s is not None and not math.isnan(s):
            groups.setdefault((g, h), []).append((-(s + 0.0), i))
    return sorted((g, h, i) for (g, h), own in groups.items() for _, i in sorted(own)[:n])


@pytest.mark.parametrize("heavy, ranges", [(10**9, 10**9), (20, 15), (1, 5)])
def test_heavy_and_light_groups_against_brute_force(spark, heavy, ranges):
    r = random.Random(heavy)
    rows = [(r.choice(["hot"] * 9 + ["b", "c", None]), r.choice([1, 1, 1, 2, None]), f"i{k:04d}", r.choice([0.5, 0.25, -0.0, 0.0, 0.75, None, float("nan"), float("inf")]), "clash", "x") for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topn.top_n(df, ["g", "h"], "score", "id", 3, heavy_rows=heavy, range_rows=ranges)
    assert sorted((x["g"], x["h"], x["id"]) for x in got.collect()) == brute(rows, 3)


def test_latest_row_decides_and_null_keys_go(spark):
    rows = [("d", 1, "b", 0, "l", 0.9), ("d", 5, "b", 0, "l", None), ("e", 2, "b", 0, "l", 0.1), ("e", 1, "b", 0, None, 0.8), (None, 9, "b", 0, "l", 1.0)]
    df = spark.createDataFrame(rows, "decision_id string, seq long, branch_id string, step int, lane string, opus_score double")
    assert [x["decision_id"] for x in topn.best_decisions(df).collect()] == ["e"]
    assert topn.best_decisions(df.where("seq < 0")).count() == 0


def test_a_group_that_stands_out_takes_the_ranges_by_itself(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 1000)) g", "concat('i', id) id", "double(id % 7) score")
    found = topn.top_n(df, ["g"], "score", "id", 2)
    plan = found._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "Union" in plan
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append((-r["score"], r["id"]))
    assert sorted((r["g"], r["id"]) for r in found.collect()) == sorted((g, i) for g, own in want.items() for _, i in sorted(own)[:2])
