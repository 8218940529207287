from datetime import datetime

from millrace.operators.commitlog import CommitLog
from millrace.streaming import ledger as streams

SCHEMA = "k string, seq long, v string"


def test_upsert_restarts_without_loss_or_repetition(spark, tmp_path):
    source, root, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: streams.upsert(streams.follow(spark, source, SCHEMA), root, mark, ["k"], "seq").awaitTermination()
    run()
    spark.createDataFrame([("a", 2, "z"), ("b", 0, "old")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    version, state = CommitLog(spark, root).latest()
    assert version == 2
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(state["data"]).collect()) == [("a", "z"), ("b", "y")]


def test_event_windows(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([(datetime(2024, 1, 1, 3), "click", 1.0), (datetime(2024, 1, 1, 9), "click", 2.0), (datetime(2024, 1, 2), "view", None)], "ts timestamp, event_type string, value double").write.parquet(path)
    out = streams.run_to_end(streams.event_windows(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)), "t_events")
    assert sorted((str(r["start"])[:10], r["event_type"], r["events"], r["value"]) for r in out.collect()) == [("2024-01-01", "click", 2, 3.0), ("2024-01-02", "view", 1, None)]


def test_appended_ledgers_are_chained_across_batches(spark, tmp_path):
    from millrace.operators import ledger

    source, root, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "branch_id string, place long, type string, payload string"
    run = lambda: streams.append_chained(streams.follow(spark, source, schema), root, mark).awaitTermination()
    spark.createDataFrame([("a", i, "t", f'{{"i":{i}}}') for i in range(5)] + [(None, 0, "t", "{}"), ("b", 9, None, None)], schema).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("a", 7, "t", "{}"), ("a", 6, "t", "{}"), ("c", 0, "t", "{}")], schema).write.mode("append").parquet(source)
    run()
    run()
    rows = streams.appended(spark, root)
    assert ledger.chain_breaks(rows).count() == 0
    assert sorted((r["branch_id"], r["seq"]) for r in rows.collect()) == [*(("a", i) for i in range(7)), ("b", 0), ("c", 0)]
    # a batch given again after its commit changes nothing
    version, state = CommitLog(spark, root).latest()
    assert version == 2 and state["batch"] == 1
