import json
import random

import pytest

from millrace.operators import audit, ledger, packing, samples, shards

LAND = "branch_id string, seq long, event_hash string, type string, payload string, landed_at timestamp, prev_hash string"


def landing(seq, version, step, rank, batch="b", at=0, **more):
    from datetime import datetime, timedelta

    p = {"global_step": step, "rank": rank, "microbatch_id": f"m{step}-{rank}", "batch_id": batch, **more}
    return ("x", seq, version, "consume_microbatch", json.dumps(p), datetime(2031, 1, 1) + timedelta(hours=at), None)


def test_discarded_beside_served_again(spark):
    rows = [
        landing(1, "a", 1, 0), landing(1, "a2", 1, 0, at=5),  # same fields, another hash
        landing(2, "b", 1, 1), landing(2, "b2", 1, 1, batch="other", at=5),
        landing(3, "c", 2, 0), landing(3, "c2", 2, 1, at=5),  # another place
        landing(4, "d", 3, 0), landing(4, "d", 3, 0, at=9),  # landed twice, never served again
        ("x", 5, None, "consume_microbatch", "{", None, None), (None, 6, "e", "consume_microbatch", "{}", None, None),
    ]
    got = {(int(r["global_step"]), int(r["rank"])): r["state"] for r in audit.compared(*audit.versions(spark.createDataFrame(rows, LAND))).collect()}
    assert got == {(1, 0): "same", (1, 1): "mismatch", (2, 0): "missing", (2, 1): "extra"}
    assert audit.compared(*audit.versions(spark.createDataFrame([], LAND))).count() == 0


def test_totals_at_marks(spark):
    r = random.Random(1)
    mb = [(b, s, r.randrange(9)) for b in "ab" for s in r.sample(range(60), 30)]
    marks = [(r.choice("abc"), r.choice([-1, 3, 20, 59, 100]), f"k{i}") for i in range(12)]
    got = {x["mark"]: x["to_n"] for x in audit.totals_at(spark.createDataFrame(mb, "branch_id string, seq long, n long"), spark.createDataFrame(marks, "branch_id string, seq long, mark string"), ["n"]).collect()}
    assert got == {k: sum(n for b, s, n in mb if b == m and s <= at) for m, at, k in marks}


def test_ancestors_of_any_depth(spark):
    chain = [("r0", None)] + [(f"r{i}", f"r{i - 1}") for i in range(1, 40)] + [("f", "r20"), ("lost", "nobody")]
    got = {(r["branch_id"], r["ancestor"]): r["depth"] for r in ledger.ancestors(spark.createDataFrame(chain, "branch_id string, parent string")).collect()}
    up = dict(chain)
    want = {}
    for b in up:
        a, d = up[b], 1
        while a is not None:
            want[b, a] = d
            a, d = up.get(a), d + 1
    assert got == want
    with pytest.raises(ValueError):
        ledger.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "branch_id string, parent string"))


DOCS = [(1, "one two three\n", "a"), (2, "@user: hi there\n@think: well then\n@answer: yes it is", "a"), (3, "x " * 40, "a"), (4, "", "a"), (5, None, "b"), (6, "@user: only a question", "b")]


def made(spark, capacity=16):
    d = spark.createDataFrame([(*r, None, None) for r in DOCS], "doc_id long, text string, lane string, min_context int, reserved boolean")
    spans = packing.layout(d)
    return packing.concat_chop(packing.items(d, spans), capacity), spans


def test_arrays_and_targets_against_plain_lists(spark):
    windows, spans = made(spark)
    grades = {}
    for s in spans.collect():
        for t in range(s["tok_start"], s["tok_end"]):
            grades[s["doc_id"], t] = s["role"] if s["graded"] else None
    want = {}
    for w in sorted(windows.collect(), key=lambda w: (w["lane"], w["window"], w["window_start"])):
        seg, pos, mask, k = want.setdefault((w["lane"], w["window"]), ([-1] * 16, [0] * 16, [0] * 16, [0]))
        for i in range(w["length"]):
            at = w["window_start"] + i
            seg[at], pos[at], mask[at] = k[0], i, int(i > 0 and grades.get((w["doc_id"], w["offset"] + i)) is not None)
        k[0] += 1
    got = samples.arrays(windows, spans, 16).collect()
    assert {(r["lane"], r["window"]): (r["segment_ids"], r["position_ids"], r["loss_mask"]) for r in got} == {k: v[:3] for k, v in want.items()}
    rows = samples.targets(windows, spans).collect()
    assert sorted((r["lane"], r["window"], r["position"]) for r in rows) == sorted((*k, i) for k, v in want.items() for i, m in enumerate(v[2]) if m)
    assert {r["role"] for r in rows} == {"text", "think", "answer", "eos"}
    assert samples.arrays(windows.where("lane = 'z'"), spans, 16).count() == 0


def test_each_rule_of_the_arrays(spark):
    good = ([0, 0, 1, -1], [0, 1, 0, 0], [0, 1, 0, 0])
    cases = {
        "": good, "length": (good[0][:3], good[1], good[2]), "mask_values": (good[0], good[1], [0, 2, 1, 0]), "loss_on_padding": (good[0], good[1], [0, 1, 0, 1]),
        "loss_on_first": (good[0], good[1], [0, 1, 1, 0]), "positions": (good[0], [0, 2, 0, 0], good[2]), "nothing_learnt": (good[0], good[1], [0, 0, 0, 0]),
        "interleaved": ([0, 0, 1, 0], [0, 1, 0, 0], [0, 1, 0, 0]), "token_after_padding": ([0, 0, -1, 1], [0, 1, 0, 0], [0, 1, 0, 0]),
    }
    df = spark.createDataFrame([(k, 0, *v) for k, v in cases.items()], "lane string, window long, segment_ids array<bigint>, position_ids array<bigint>, loss_mask array<bigint>")
    for r in samples.array_problems(df, 4).collect():
        assert (r["lane"] in r["problems"]) if r["lane"] else r["problems"] == [], r


def test_each_fault_of_a_manifest(spark):
    spans = [("ok", 1, 0, 5), ("ok", 2, 5, 9), ("empty", 1, 0, 5), ("empty", 2, 5, 5), ("back", 1, 0, 5), ("back", 2, 5, 3), ("over", 1, 0, 5), ("over", 2, 4, 9), ("gap", 1, 0, 5), ("gap", 2, 6, 9), ("count", 1, 0, 5), ("twice", 1, 0, 5), ("twice", 1, 5, 9), ("hash", 1, 0, 5), ("wild", 1, 0, 2)]
    cards = [("ok", 9, "h"), ("empty", 5, "h"), ("back", 5, "h"), ("over", 9, "h"), ("gap", 9, "h"), ("count", 6, "h"), ("twice", 9, "h"), ("hash", 5, None), ("none", 0, "h"), ("", 0, "h")]
    got = {r["shard_id"]: r["problems"] for r in samples.manifest_problems(spark.createDataFrame(spans, "shard_id string, doc_id long, token_start long, token_end long"), spark.createDataFrame(cards, "shard_id string, token_count long, content_hash string")).collect()}
    assert got == {
        "empty": ["empty_span"], "back": ["backward_span"], "over": ["overlap"], "gap": ["gap"], "count": ["other_count"], "twice": ["document_twice"],
        "hash": ["no_content_hash"], "none": ["no_spans"], "": ["no_id", "no_spans"], "wild": ["no_content_hash", "other_count"],
    }


def test_hints_and_missing_tokenizer_hash(spark):
    d = spark.createDataFrame([("a", "early"), ("a", "mid"), ("b", None), ("b", "odd"), ("c", "anneal"), ("c", "mid")], "shard_id string, stage_hint string")
    assert {r["shard_id"]: r["hint"] for r in samples.dominant_hints(d).collect()} == {"a": "mid", "b": "early", "c": "anneal"}
    own = spark.createDataFrame([("s1", "x", 5, "t"), ("s2", "x", 5, None), ("s3", "x", 0, "")], "shard_id string, source string, token_count long, tokenizer_hash string")
    sources = spark.createDataFrame([("x", "code", "A", "v1", None, None, True, "scanned_clean")], "source_id string, lane string, licence_tier string, cleaning_pipeline string, never_train boolean, held_out boolean, loss_bearing boolean, contamination_status string")
    got = {r["shard_id"]: r["reasons"] for r in shards.gate(own, sources).collect()}
    assert got == {"s1": [], "s2": ["tokenizer_hash_missing"], "s3": ["shard_has_no_tokens", "tokenizer_hash_missing"]}


def test_a_check_that_saw_nothing_has_not_passed(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    got = {r["check"]: (r["bad"], r["looked_at"], r["passed"]) for r in audit.verdicts([audit.check(df, "a", F.col("n") > 1), audit.check(df.where("n = 1"), "b", F.col("n") > 1), audit.check(df.where("n = 9"), "c", F.col("n") > 1)]).collect()}
    assert got == {"a": (1, 3, False), "b": (0, 1, True), "c": (0, 0, False)}
