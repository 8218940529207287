import random
from datetime import datetime, timedelta

import pytest

from millrace.operators import incremental
from millrace.operators.commitlog import CommitConflict, CommitLog

T0 = datetime(2031, 1, 1)
LANDINGS = "branch_id string, seq long, event_hash string, landed_at timestamp, mark string, c string"


def at(hours):
    return T0 + timedelta(hours=hours)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], LANDINGS)


def marks(spark, rows):
    return spark.createDataFrame(rows, "branch_id string, mark timestamp")


def brute(rows, mark):
    out = set()
    keys = {(b, s) for b, s, h, t in rows if None not in (b, s, h, t)}
    for b, s in keys:
        own = sorted((t, h) for x, y, h, t in rows if (x, y) == (b, s) and h is not None and t is not None)
        c = mark.get(b)
        seen = [x for x in own if c is not None and x[0] <= c]
        if (c is None or own[-1][0] > c) and (not seen or seen[-1][1] != own[-1][1]):
            out.add((b, s))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_changed_records_against_brute_force(spark, seed):
    r = random.Random(seed)
    # one branch holds most landings; nulls, repeats and equal instants occur
    rows = [(r.choice(["a"] * 6 + ["b", "c", None]), r.choice([*range(20), None]), r.choice(["h1", "h2", "h3", None]), r.choice([at(r.randrange(30)), None] if r.random() < 0.1 else [at(r.randrange(30))])) for _ in range(400)]
    mark = {"a": at(14), "b": None}
    got = incremental.changed_records(frame(spark, rows), marks(spark, list(mark.items())), None)
    assert {(x["branch_id"], x["seq"]) for x in got.collect()} == brute(rows, mark)
    assert got.count() == len(brute(rows, mark))


def test_upper_bound_hides_later_landings(spark):
    rows = [("a", 1, "h1", at(1)), ("a", 1, "h2", at(5)), ("a", 2, "h1", at(6))]
    got = incremental.changed_records(frame(spark, rows), marks(spark, []), at(4)).collect()
    assert [(x["seq"], x["event_hash"]) for x in got] == [(1, "h1")]


def test_empty_tables(spark):
    assert incremental.changed_records(frame(spark, []), marks(spark, []), None).count() == 0
    assert incremental.upper_bound(frame(spark, [])) is None


def test_runs_neither_skip_nor_repeat_after_a_failure(spark, tmp_path):
    rows = [("a", i, f"h{i}", at(i)) for i in range(5)] + [("b", 0, "g", at(2)), ("a", 9, None, at(1))]
    reader = incremental.IncrementalReader(spark, str(tmp_path / "state"))

    def fail(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        reader.run(frame(spark, rows), fail)
    first = {(x["branch_id"], x["seq"]) for x in reader.run(frame(spark, rows)).collect()}
    assert first == {("a", i) for i in range(5)} | {("b", 0)}
    assert reader.run(frame(spark, rows)).count() == 0
    later = rows + [("a", 3, "new", at(20)), ("a", 4, "h4", at(21)), ("b", 1, "g", at(22))]
    assert {(x["branch_id"], x["seq"]) for x in reader.run(frame(spark, later)).collect()} == {("a", 3), ("b", 1)}
    assert len(reader.outputs()) == 3


def test_only_one_of_two_runs_commits(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.commit(0, {"x": 1}) == 1
    with pytest.raises(CommitConflict):
        log.commit(0, {"x": 2})
    assert log.latest() == (1, {"x": 1})


FEED = "branch_id string, seq long, event_hash string, landed_at timestamp, mark string, c string"


def taken(df):
    return {(x["branch_id"], x["seq"], x["event_hash"]) for x in df.collect()}


def test_rows_that_become_visible_late_are_taken_once(spark, tmp_path):
    feed = incremental.Feed(spark, str(tmp_path / "feed"), FEED)
    reader = incremental.IncrementalReader(spark, str(tmp_path / "reader"))
    assert reader.run(feed).count() == 0
    feed.append(frame(spark, [("a", 1, "h1", at(1)), ("a", 2, "h2", at(5))]))
    assert taken(reader.run(feed)) == {("a", 1, "h1"), ("a", 2, "h2")}
    # landed before what was read, and at the same instant as its last; an older version of a seen record
    feed.append(frame(spark, [("a", 3, "h3", at(4)), ("a", 4, "h4", at(5)), ("a", 2, "old", at(3)), ("b", 1, "x", at(0)), ("a", 1, "h1", at(9)), ("a", 5, None, at(9))]))
    feed.append(frame(spark, [("b", 1, "y", at(0)), ("b", 1, "w", at(0))]))
    assert taken(reader.run(feed)) == {("a", 3, "h3"), ("a", 4, "h4"), ("b", 1, "y")}
    assert reader.log.latest()[1]["commits_read"] == 2
    assert reader.run(feed).count() == 0 and reader.log.latest()[1]["commits_read"] == 0
    # there and back again is no change
    feed.append(frame(spark, [("b", 1, "z", at(3)), ("b", 1, "y", at(4))]))
    assert reader.run(feed).count() == 0


def test_a_crash_between_output_and_commit_repeats_nothing(spark, tmp_path, monkeypatch):
    feed = incremental.Feed(spark, str(tmp_path / "feed"), FEED)
    reader = incremental.IncrementalReader(spark, str(tmp_path / "reader"))
    feed.append(frame(spark, [("a", i, f"h{i}", at(i)) for i in range(6)]))
    commit = reader.log.commit

    def die(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(reader.log, "commit", die)
    with pytest.raises(RuntimeError):
        reader.run(feed)
    monkeypatch.setattr(reader.log, "commit", commit)
    feed.append(frame(spark, [("a", 9, "h9", at(0))]))
    assert {s for _, s, _ in taken(reader.run(feed))} == {*range(6), 9}
    assert reader.run(feed).count() == 0 and len(reader.outputs()) == 2


def test_what_lands_during_a_run_waits_for_the_next(spark, tmp_path):
    feed = incremental.Feed(spark, str(tmp_path / "feed"), FEED)
    reader = incremental.IncrementalReader(spark, str(tmp_path / "reader"))
    feed.append(frame(spark, [("a", 1, "h1", at(1))]))

    def meanwhile(df):
        feed.append(frame(spark, [("a", 2, "h2", at(0))]))
        return df

    assert taken(reader.run(feed, meanwhile)) == {("a", 1, "h1")}
    assert taken(reader.run(feed)) == {("a", 2, "h2")}


def test_layers_of_the_state_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "LAYERS", 2)
    r = random.Random(1)
    feed = incremental.Feed(spark, str(tmp_path / "feed"), FEED)
    reader = incremental.IncrementalReader(spark, str(tmp_path / "reader"))
    last = {}
    for k in range(5):
        rows = [("a", r.randrange(12), r.choice("xyz"), at(r.randrange(40))) for _ in range(8)]
        feed.append(frame(spark, rows))
        before = {k: v[1] for k, v in last.items()}
        for b, s, h, t in rows:
            last[b, s] = max(last.get((b, s), (at(-1), "")), (t, h))
        assert taken(reader.run(feed)) == {(*k, v[1]) for k, v in last.items() if before.get(k) != v[1]}
        assert len(reader.log.latest()[1]["seen"]) <= 2
