import random
from datetime import datetime, timedelta

from millrace.operators import references as R

T0 = datetime(2031, 1, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def brute(refs, parents):
    out = set()
    for field, key, owner, seq, t in refs:
        if not key:
            continue
        own = [(f, g) for x, k, f, g in parents if (x, k) == (field, key)]
        if not own:
            state = "missing"
        else:
            firsts = [f for f, _ in own if f is not None]
            gone = None if any(g is None for _, g in own) else max(g for _, g in own)
            if firsts and t is not None and min(firsts) > t:
                state = "late"
            elif gone is not None and t is not None and gone <= t:
                state = "deleted"
            else:
                continue
        out.add((field, key, owner, seq, state))
    return out


def made(seed):
    r = random.Random(seed)
    keys = ["hot"] * 5 + [f"k{i}" for i in range(12)] + [None, ""]
    refs = [("f", r.choice(keys), r.choice(["o", "p", None]), i, at(r.choice([*range(20), None]))) for i in range(120)]
    parents = [("f", f"k{i}", at(r.randrange(20)), at(r.choice([None, 5, 10]))) for i in range(0, 12, 2)] + [("f", "hot", at(3), None), ("g", "k1", at(0), None)]
    return refs, parents


def rows(df):
    return {(x["ref_field"], x["ref_key"], x["owner"], x["seq"], x["ref_state"]) for x in df.collect()}


def frames(spark, refs, parents):
    return spark.createDataFrame(refs, R.REFS), spark.createDataFrame(parents, R.PARENTS)


def test_one_batch_against_brute_force(spark):
    for seed in range(2):
        refs, parents = made(seed)
        assert rows(R.advance(None, None, None, *frames(spark, refs, parents))) == brute(refs, parents)


def test_batches_end_where_one_batch_ends(spark, tmp_path):
    refs, parents = made(7)
    state = R.PendingOrphans(spark, str(tmp_path / "s"))
    cuts = [(refs[:40], parents[:2]), (refs[40:90], parents[2:5]), (refs[90:], parents[5:])]
    seen_refs, seen_parents = [], []
    for some, more in cuts:
        seen_refs += some
        seen_parents += more
        assert rows(state.batch(*frames(spark, some, more))) == brute(seen_refs, seen_parents)


def test_deletion_reopens_and_arrival_resolves(spark, tmp_path):
    state = R.PendingOrphans(spark, str(tmp_path / "s"))
    ref = [("f", "k", "o", 1, at(10))]
    assert rows(state.batch(*frames(spark, ref, []))) == {("f", "k", "o", 1, "missing")}
    assert rows(state.batch(*frames(spark, [], [("f", "k", at(2), None)]))) == set()
    assert rows(state.batch(*frames(spark, [], [("f", "k", at(2), at(9))]))) == {("f", "k", "o", 1, "deleted")}


def test_empty(spark):
    assert R.advance(None, None, None, *frames(spark, [], [])).count() == 0


def test_counts_per_day(spark):
    found = R.advance(None, None, None, *frames(spark, [("f", "x", "o", 1, at(1)), ("f", "x", "o", 2, at(30))], []))
    assert sorted((str(r["day"]), r["orphans"]) for r in R.counts(found).collect()) == [("2031-01-01", 1), ("2031-01-02", 1)]


def test_queries_read_the_state_of_batches(spark, tmp_path, monkeypatch):
    from millrace.plans import upkeep

    stamp = lambda h: None if h is None else f"2031-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    recs = [("b", i, 3 * i if i % 7 else None, 90 + i, f"d{i % 9}", f"c{i % 4}" if i % 3 else "") for i in range(30)] + [("b", 4, 12, 10, "d1", "c9"), (None, 1, 5, 5, "d0", None)]
    decisions = [(f"d{k}", h) for k, h in ((0, 1), (1, 20), (1, 4), (2, 30), (4, None), (5, 88), (6, 200))] + [(None, 3)]
    saved = [("c0", 2, 40), ("c1", 1, None), ("c1", 1, 30), ("c2", 50, 60), ("c2", 9, 75), ("c3", None, 8)]
    text = lambda rows, where: [tuple(stamp(x) if k in where else x for k, x in enumerate(r)) for r in rows]
    learning = spark.createDataFrame(text(recs, (2, 3)), "branch_id string, seq long, recorded_at string, landed_at string, d string, k string")
    learning.selectExpr("branch_id", "seq", "cast(recorded_at as timestamp) recorded_at", "cast(landed_at as timestamp) landed_at", "named_struct('opus_decision_id', d, 'checkpoint_before', k) payload").write.parquet(str(tmp_path / "learning_ledger.parquet"))
    spark.createDataFrame(text(decisions, (1,)), "decision_id string, t string").selectExpr("decision_id", "cast(t as timestamp) recorded_at").write.parquet(str(tmp_path / "opus_decisions.parquet"))
    spark.createDataFrame(text(saved, (1, 2)), "checkpoint_id string, s string, e string").selectExpr("checkpoint_id", "cast(s as timestamp) saved_at", "cast(e as timestamp) deleted_at").write.parquet(str(tmp_path / "checkpoints.parquet"))

    seen, batch = [], R.PendingOrphans.batch

    def counted(self, refs, parents):
        seen.append((refs.count(), parents.where("gone_at is null").count(), parents.where("gone_at is not null").count()))
        return batch(self, refs, parents)

    monkeypatch.setattr(R.PendingOrphans, "batch", counted)
    got = sorted(map(tuple, upkeep.p6_found(spark, str(tmp_path)).collect()), key=repr)
    assert len([x for x in seen if x[0]]) >= 3 and len([x for x in seen if x[1]]) >= 3 and sum(x[2] for x in seen) == 3
    tables = [spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("learning_ledger", "opus_decisions", "checkpoints")]
    once = R.advance(None, None, None, R.ledger_refs(tables[0]), R.ledger_parents(*tables[1:]))
    assert got == sorted(map(tuple, once.select("owner", "seq", "ref_field", "ref_state").collect()), key=repr)
    assert {x[3] for x in got} == {"missing", "late", "deleted"}
    assert sum(r["orphans"] for r in upkeep.p6_by_day(spark, str(tmp_path)).collect()) == len(got)


def test_layers_are_merged_and_only_touched_buckets_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "LAYERS", 2)
    refs, parents = made(11)
    state = R.PendingOrphans(spark, str(tmp_path / "s"))
    seen_refs, seen_parents = [], []
    for k in range(6):
        some, more = refs[20 * k : 20 * k + 20], parents[k : k + 1] if k < 5 else [("f", "k2", at(99), None), *parents[5:]]
        seen_refs += some
        seen_parents += more
        assert rows(state.batch(*frames(spark, some, more))) == brute(seen_refs, seen_parents)
        assert len(state.log.latest()[1]["refs"]) <= 2
    assert rows(state.open()) == brute(seen_refs, seen_parents)
    assert state.snapshots().groupBy("batch").count().count() == 6
    # one parent: its bucket only
    state.batch(*frames(spark, [], [("f", "k1", at(1), None)]))
    assert state.log.latest()[1]["buckets_read"] == {"refs": 1, "parents": 1}
    state.batch(*frames(spark, [("f", "k3", "o", 900, at(5))], []))
    assert state.log.latest()[1]["buckets_read"] == {"refs": 0, "parents": 1}


def test_a_batch_that_fails_is_given_again(spark, tmp_path, monkeypatch):
    state = R.PendingOrphans(spark, str(tmp_path / "s"))
    state.batch(*frames(spark, [("f", "k", "o", 1, at(10)), ("f", "j", "o", 2, at(10))], []))
    commit = state.log.commit

    def die(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(state.log, "commit", die)
    for _ in range(2):
        try:
            state.batch(*frames(spark, [("f", "z", "o", 3, at(1))], [("f", "k", at(2), None)]))
        except RuntimeError:
            pass
    monkeypatch.setattr(state.log, "commit", commit)
    assert rows(state.open()) == {("f", "k", "o", 1, "missing"), ("f", "j", "o", 2, "missing")}
    assert rows(state.batch(*frames(spark, [("f", "z", "o", 3, at(1))], [("f", "k", at(2), None)]))) == {("f", "j", "o", 2, "missing"), ("f", "z", "o", 3, "missing")}
