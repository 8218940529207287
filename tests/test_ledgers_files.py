import json

from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import ledger
from millrace.sources.lanes import read_lane_files, read_sources
from millrace.sources.ledger_files import append, read_ledger, repair


def chain(n, branch="b"):
    rows, prev = [], ledger.GENESIS
    for i in range(n):
        payload = hashing.canonical_json({"i": i, "s": "ä"})
        h = hashing.sha256(hashing.canonical_json({"payload": json.loads(payload), "prev_hash": prev, "seq": i, "type": "t"}))
        rows.append([branch, i, prev, h, "t", payload])
        prev = h
    return rows


SCHEMA = "branch_id string, seq long, prev_hash string, event_hash string, type string, payload string"


def breaks(spark, rows):
    return {(r["seq"], r["problem"]) for r in ledger.chain_breaks(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_chain_names_the_altered_record(spark):
    rows = chain(8)
    assert breaks(spark, rows) == set()
    edited = [list(r) for r in rows]
    edited[3][5] = '{"i":99,"s":"ä"}'
    assert breaks(spark, edited) == {(3, "hash")}
    assert breaks(spark, rows[:4] + rows[5:]) == {(5, "gap")}
    assert breaks(spark, []) == set()


def test_append_and_torn_tail(spark, tmp_path):
    path = str(tmp_path / "l.jsonl")
    assert append(path, [("a", {"x": 1}), ("b", {"x": 2})]) == 2
    with open(path, "a") as f:
        f.write('{"seq":2,"to')
    states = {r["state"]: r["n"] for r in read_ledger(spark, path).groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert states == {"whole": 2, "torn": 1}
    assert append(path, [("c", {"x": 3})]) == 3
    rows = read_ledger(spark, path)
    assert rows.where("state <> 'whole'").count() == 0
    records = rows.select(F.lit("b").alias("branch_id"), "seq", "prev_hash", "event_hash", "type", "payload")
    assert ledger.chain_breaks(records).count() == 0
    assert repair(path)[0] == 3


def test_canonical_json_hash_matches_the_column(spark):
    rows = chain(2)
    got = spark.createDataFrame(rows, SCHEMA).select(ledger.event_hash(F.col("seq"), F.col("prev_hash"), F.col("type"), F.col("payload")).alias("h"), "event_hash").collect()
    assert all(r["h"] == r["event_hash"] for r in got)


def test_merkle_seed_and_masks(spark):
    a, b, c = (hashing.sha256(x) for x in "abc")
    pair = lambda x, y: hashing.sha256(bytes.fromhex(x) + bytes.fromhex(y))
    assert hashing.merkle_root([a, b, c]) == pair(pair(a, b), pair(c, c))
    assert hashing.merkle_root([]) == hashing.sha256(b"")
    assert hashing.mask_hash([1, 0, 1]) == hashing.sha256(bytes([0b10100000]))
    assert hashing.token_hash([1, 258]) == hashing.sha256(b"\x01\0\0\0\x02\x01\0\0")
    got = spark.createDataFrame([("r", 3)], "a string, b int").select(hashing.seed_column("a", "b").alias("s")).first()["s"]
    assert got == hashing.seed("r", 3)


def test_lane_files_and_sources(spark, tmp_path):
    lane = tmp_path / "lane.txt"
    lane.write_text("# head\n===DOC===\ndoc_id: d1\nlang: en\nscript: Latn\nreserved: yes\n---\nHello\n\nworld\n===DOC===\ndoc_id: d2\nlang: en\n---\nx\n===DOC===\nno separator\n", encoding="utf-8")
    rows = {r["doc_id"]: r for r in read_lane_files(spark, str(lane)).collect()}
    assert rows["d1"]["text"] == "Hello\n\nworld" and rows["d1"]["reserved"] and rows["d1"]["problem"] is None
    assert rows["d2"]["problem"] == "no script" and rows[None]["problem"] == "no separator"
    contract = tmp_path / "s.json"
    contract.write_text(json.dumps({"sources": [{"source_id": "b", "lane": "code"}, {"source_id": "a", "never_train": True}]}))
    got = read_sources(spark, str(contract)).collect()
    assert [r["source_id"] for r in got] == ["a", "b"] and got[0]["never_train"] and got[1]["loss_bearing"]
