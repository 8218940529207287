"""Ledgers as files of JSON lines."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import canonical_json, sha256
from millrace.operators.ledger import GENESIS

RECORD = "seq long, prev_hash string, event_hash string, type string, payload string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Whole records, and lines that are none with state torn or damaged.

    A torn line lacks the end of its JSON; a damaged one is JSON of something
    else. Blank lines don't count. (file, state, line and the record's fields)
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    obj = F.from_json("value", "seq long, prev_hash string, event_hash string, type string")
    rows = lines.select("file", F.col("value").alias("line"), obj.alias("r"), F.get_json_object("value", "$.payload").alias("payload"), F.get_json_object("value", "$").isNotNull().alias("json"))
    state = F.when(~F.col("json"), "torn").when(F.col("r.seq").isNull() | F.col("r.event_hash").isNull(), "damaged").otherwise("whole")
    return rows.select("file", state.alias("state"), "line", "r.*", "payload")


def append(path: str, events: Iterable[tuple[str, dict]]) -> int:
    """Append (type, payload) events to one local ledger file, each chained to
    the one before and forced to disk; the next seq. A torn last line is cut
    off first. One writer per file; many ledgers are written in parallel."""
    seq, prev = repair(path)
    with open(path, "ab") as file:
        for kind, payload in events:
            body = {"payload": payload, "prev_hash": prev, "seq": seq, "type": kind}
            prev = sha256(canonical_json(body))
            file.write((canonical_json({**body, "event_hash": prev}) + "\n").encode())
            file.flush()
            os.fsync(file.fileno())
            seq += 1
    return seq


def repair(path: str) -> tuple[int, str]:
    """Cut off what follows the last whole record: (next seq, its hash)."""
    seq, prev, good = 0, GENESIS, 0
    if not os.path.exists(path):
        return seq, prev
    with open(path, "r+b") as file:
        for line in file:
            try:
                record = json.loads(line) if line.endswith(b"\n") else None
            except ValueError:
                record = None
            if record is None:
                break
            seq, prev, good = record["seq"] + 1, record["event_hash"], good + len(line)
        file.truncate(good)
    return seq, prev
