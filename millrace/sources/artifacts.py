"""Reports, manifests, checkpoints and events as files in a shared folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import canonical_json, sha256
from millrace.operators.commitlog import CommitLog


class Folder:
    """Small files that appear whole or not at all: each is written under a
    scratch name and renamed. A written file is never written again."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, root)
        self.root, self._fs, self._path = self.log.root, self.log._fs, self.log._path

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def write(self, name: str, data: bytes) -> None:
        """FileExistsError if there is one of this name."""
        target = self._path(f"{self.root}/{name}")
        if self._fs.exists(target):
            raise FileExistsError(name)
        scratch = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self._fs.create(scratch, False)
        out.write(bytearray(data))
        out.close()
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(scratch, target):
            self._fs.delete(scratch, False)
            raise FileExistsError(name)

    def read(self, name: str) -> bytes | None:
        """None if there is no such file."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def names(self, folder: str = "") -> list[str]:
        path = f"{self.root}/{folder}".rstrip("/")
        if not self._fs.exists(self._path(path)):
            return []
        return sorted(n for n in self.log.names(path) if not n.startswith((".", "_")))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def write_json(self, name: str, value) -> str:
        """As canonical JSON; its hash."""
        text = canonical_json(value)
        self.write(name, text.encode())
        return sha256(text)

    def read_json(self, name: str):
        """The value, or None if the file is missing or no JSON."""
        data = self.read(name)
        try:
            return None if data is None else json.loads(data)
        except ValueError:
            return None


def write_manifests(folder: Folder, manifests: DataFrame, name: str) -> dict:
    """A table of manifests as files of JSON lines beside one card, which names
    its content by a hash that doesn't depend on how the rows are spread. The
    card is written last; without it there is no such artifact."""
    path = folder.log.fresh("manifests")
    rows = manifests.select(F.to_json(F.struct(*sorted(manifests.columns)), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.text(path)
    back = manifests.sparkSession.read.text(path)
    # rows hashed one by one and summed up: equal tables have equal sums
    n, low, high = back.agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "value").cast("decimal(38,0)"))).first()
    card = {"path": path, "rows": n, "content": sha256(f"{n}|{low}|{high}")[:16]}
    folder.write_json(f"{name}.json", card)
    return card


def read_manifests(spark: SparkSession, folder: Folder, name: str, schema: str) -> DataFrame | None:
    """The table of write_manifests; None if it was never finished."""
    card = folder.read_json(f"{name}.json")
    return None if card is None else spark.read.schema(schema).json(card["path"])


class Checkpoints:
    """Checkpoints of branches: what is said of one, and its state.

    A checkpoint is there if both are; what is said of it is written last.
    Pruning takes the state of all but the newest and leaves what is said.
    """

    def __init__(self, folder: Folder):
        self.folder = folder

    def _at(self, branch: str, step: int, what: str) -> str:
        return f"{branch}/{step:012d}.{what}"

    def save(self, branch: str, step: int, meta: dict, state: bytes) -> str:
        """The hash of what is said of it, which has the state's hash."""
        self.folder.write(self._at(branch, step, "state"), state)
        return self.folder.write_json(self._at(branch, step, "json"), {**meta, "branch_id": branch, "global_step": step, "state_hash": sha256(state.hex())})

    def steps(self, branch: str) -> list[int]:
        """Steps with a whole checkpoint, in order."""
        names = set(self.folder.names(branch))
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and f"{n[:12]}.state" in names)

    def load(self, branch: str, step: int | None = None) -> tuple[dict, bytes] | None:
        """A checkpoint, by default the newest; None if it isn't whole, an
        error if its state isn't the one that was saved."""
        steps = self.steps(branch)
        step = steps[-1] if step is None and steps else step
        if step not in steps:
            return None
        meta, state = self.folder.read_json(self._at(branch, step, "json")), self.folder.read(self._at(branch, step, "state"))
        if meta is None or meta["state_hash"] != sha256(state.hex()):
            raise ValueError(f"checkpoint {branch} {step} was altered")
        return meta, state

    def prune(self, branch: str, keep: int = 2) -> list[int]:
        """Steps whose state was taken away."""
        gone = self.steps(branch)[: -keep or None] if keep else self.steps(branch)
        for step in gone:
            self.folder.delete(self._at(branch, step, "state"))
        return gone


class EventLog:
    """Events as lines to be read and as JSON, both with the same number.

    Fixed values: levels. Each event is one file, so writers never disturb
    each other; one that takes a number first has it.
    """

    LEVELS = ("info", "milestone", "pass", "fail")

    def __init__(self, folder: Folder):
        self.folder, self.next = folder, len(folder.names("events"))

    def emit(self, level: str, message: str, **fields) -> str:
        """The line that was written."""
        if level not in self.LEVELS:
            raise ValueError(level)
        while True:
            line = f"[{self.next:06d}] {level.upper()} {message}"
            try:
                self.folder.write_json(f"events/{self.next:012d}.json", {"seq": self.next, "level": level, "message": message, "line": line, "fields": fields})
            except FileExistsError:
                self.next += 1
                continue
            self.next += 1
            return line

    def read(self, spark: SparkSession) -> DataFrame:
        """(seq, level, message, line) of all events."""
        if not self.folder.names("events"):
            return spark.createDataFrame([], "seq long, level string, message string, line string")
        return spark.read.schema("seq long, level string, message string, line string").json(f"{self.folder.root}/events")


def milestones_in_order(events: DataFrame, wanted: list[str]) -> DataFrame:
    """(milestone, first, in_order): the first event that has each of the
    wanted messages, which must come one after another; a missing one isn't in order."""
    spark = events.sparkSession
    names = spark.createDataFrame(list(enumerate(wanted)), "k int, milestone string")
    first = events.where(F.col("level") == "milestone").groupBy(F.col("message").alias("milestone")).agg(F.min("seq").alias("first"))
    rows = names.join(first, "milestone", "left")
    # the list is short, and so is its order
    found = {r["k"]: r["first"] for r in rows.collect()}
    out = [(m, found[k], found[k] is not None and all(found[j] is not None and found[j] < found[k] for j in range(k))) for k, m in enumerate(wanted)]
    return spark.createDataFrame(out, "milestone string, first long, in_order boolean")
