import pytest

from millrace.sources.artifacts import Checkpoints, EventLog, Folder, milestones_in_order, read_manifests, write_manifests


def test_files_are_written_once_and_whole(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "a"))
    h = f.write_json("x/report.json", {"b": 1.5, "a": ["ä", None]})
    assert f.read_json("x/report.json") == {"a": ["ä", None], "b": 1.5} and len(h) == 64
    with pytest.raises(FileExistsError):
        f.write_json("x/report.json", {})
    f.write("bad.json", b'{"cut')
    assert f.read_json("bad.json") is None and f.read_json("none.json") is None and f.read("none") is None
    assert f.names("x") == ["report.json"] and f.names("nowhere") == []


def test_manifests_are_named_by_content(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(f"s{i}", i if i % 2 else None) for i in range(20)], "shard_id string, n int")
    one, two = write_manifests(f, df, "one"), write_manifests(f, df.repartition(5), "two")
    other = write_manifests(f, df.where("n > 3"), "other")
    assert one["content"] == two["content"] != other["content"] and one["rows"] == 20
    assert sorted(map(tuple, read_manifests(spark, f, "two", "shard_id string, n int").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert read_manifests(spark, f, "never", "shard_id string") is None
    assert write_manifests(f, df.where("n < 0"), "empty")["rows"] == 0


def test_checkpoints(spark, tmp_path):
    c = Checkpoints(Folder(spark, str(tmp_path / "c")))
    assert c.load("b") is None and c.steps("b") == []
    for step in (0, 6, 12):
        c.save("b", step, {"stage": "one"}, f"state {step}".encode())
    c.folder.write(f"b/{18:012d}.state", b"no word of it")
    assert c.steps("b") == [0, 6, 12] and c.load("b")[1] == b"state 12" and c.load("b", 6)[0]["global_step"] == 6 and c.load("b", 7) is None
    with pytest.raises(FileExistsError):
        c.save("b", 6, {}, b"again")
    assert c.prune("b", 2) == [0] and c.steps("b") == [6, 12]
    c.folder.delete(f"b/{12:012d}.state")
    c.folder.write(f"b/{12:012d}.state", b"altered")
    with pytest.raises(ValueError):
        c.load("b", 12)


def test_events_have_one_number_in_both_forms(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "e"))
    a, b = EventLog(f), EventLog(f)
    assert a.read(spark).count() == 0
    lines = [a.emit("milestone", "built", shards=3), b.emit("pass", "checked"), a.emit("milestone", "trained"), b.emit("milestone", "audited")]
    rows = a.read(spark).orderBy("seq").collect()
    assert [r["line"] for r in rows] == lines and [r["seq"] for r in rows] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        a.emit("loud", "x")
    found = {r["milestone"]: r["in_order"] for r in milestones_in_order(a.read(spark), ["built", "audited", "trained", "never"]).collect()}
    assert found == {"built": True, "audited": True, "trained": False, "never": False}
