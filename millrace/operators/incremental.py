"""Processing only new or changed records, between two fixed marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.commitlog import CommitConflict, CommitLog
from millrace.operators.joins import lookup_join
from millrace.operators.layers import LAYERS, Layers


def upper_bound(landings: DataFrame, at: str = "landed_at"):
    """The greatest landing time, read once when a run starts; None if empty."""
    return landings.agg(F.max(at).alias("upto")).first()["upto"]


def changed_records(landings: DataFrame, marks: DataFrame, upto, feed: str = "branch_id", seq: str = "seq", version: str = "event_hash", at: str = "landed_at", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records whose latest landing up to ``upto`` lies after their feed's mark
    and which the mark had not seen, or had last seen in another version.

    landings: one row per landing. marks: (feed, mark), one row per feed; a
    feed without a row or with a null mark has seen nothing. Landings with a
    null feed, seq, version or landing time are no records yet and are left
    out; a repeated landing changes nothing; of landings at the same instant
    the one with the greater version counts as the later. An empty table gives
    no rows. Columns besides those named, whatever their names, are ignored
    but for those in ``keep``, which come from the latest landing.

    One shuffle, on (feed, seq): the landings are reduced to two per key and
    task before it, so a feed that holds most rows stays spread by seq.
    """
    rows = landings.where(F.col(version).isNotNull() & F.col(feed).isNotNull() & F.col(seq).isNotNull() & F.col(at).isNotNull())
    if upto is not None:
        rows = rows.where(F.col(at) <= F.lit(upto))
    rows = rows.select(feed, seq, version, at, *keep)
    marked = lookup_join(rows, marks.where(F.col(feed).isNotNull()).select(F.col(feed), F.col("mark").alias("_mark")), [feed])
    landing = F.struct(F.col(at).alias("at"), F.col(version).alias("version"), *[F.col(c) for c in keep])
    seen = F.struct(F.col(at).alias("at"), F.col(version).alias("version"))
    return (
        marked.groupBy(feed, seq)
        .agg(F.max(landing).alias("_last"), F.max(F.when(F.col(at) <= F.col("_mark"), seen)).alias("_seen"), F.max("_mark").alias("_mark"))
        .where(F.col("_mark").isNull() | (F.col("_last.at") > F.col("_mark")))
        .where(F.col("_seen").isNull() | (F.col("_seen.version") != F.col("_last.version")))
        .select(feed, seq, F.col("_last.version").alias(version), F.col("_last.at").alias(at), *[F.col("_last")[c].alias(c) for c in keep])
    )


def run_marks(runs: DataFrame, feed: str = "branch_id") -> DataFrame:
    """What the last successful run of each feed had read: (feed, mark).

    Failed, cancelled and unfinished runs, and those without a status, don't
    move the mark; a run over an old stretch doesn't set it back.
    """
    done = runs.where((F.col("status") == "succeeded") & F.col(feed).isNotNull())
    return done.groupBy(feed).agg(F.max("read_upto").alias("mark"))


class Feed:
    """An append-only table in a shared folder whose appends are numbered when
    they become visible: the commit sequence that readers go by. Whatever
    times its rows carry, a row appended later has a later number."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.log, self.schema = spark, CommitLog(spark, root), schema

    def append(self, rows: DataFrame) -> int:
        """Add rows in one commit; its number. Writers may append at once."""
        path = self.log.fresh("rows")
        rows.write.parquet(path)
        while True:
            try:
                return self.log.commit(self.last(), {"rows": path})
            except CommitConflict:
                continue

    def last(self) -> int:
        """The newest commit, 0 if there is none."""
        return self.log.latest()[0]

    def between(self, after: int, upto: int) -> DataFrame:
        """Rows of the commits after one and up to another; no others are opened."""
        paths = [self.log.read(v)["rows"] for v in range(after + 1, upto + 1)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


class IncrementalReader:
    """Runs that each take what is new or changed since the last committed one.

    A run fixes its upper bound, the feed's newest commit, when it starts and
    reads only the commits after its mark. It writes the latest landing of each
    record in them once, and takes both its output and its new state from that,
    so a landing that comes meanwhile is in neither. Output, state and mark
    are committed in one manifest: a run that fails at any point before leaves
    all as it was, and the next takes the same commits again; of two runs at
    once only one can commit. The state has, by buckets of (feed, seq), the
    latest landing of every record seen, so a landing that becomes visible
    late is still new if its record is, and is no change if a later one was
    seen. Landings with a null feed, seq, version or time are no records.
    """

    def __init__(self, spark: SparkSession, root: str, feed: str = "branch_id", seq: str = "seq", version: str = "event_hash", at: str = "landed_at"):
        self.spark, self.log = spark, CommitLog(spark, root)
        self.feed, self.seq, self.version, self.at = feed, seq, version, at

    def _layers(self, rows: DataFrame, kind: str, columns: list[str]) -> Layers:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
        return Layers(self.log, kind, [self.feed, self.seq], schema)

    def run(self, landings: Feed | DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Take the new and changed records, apply ``transform``, commit; the
        run's output. A DataFrame in place of a feed has all landings so far,
        and is compared with the state as a whole."""
        number, state = self.log.latest()
        mark = state.get("upto", 0)
        upto = landings.last() if isinstance(landings, Feed) else mark
        rows = landings.between(mark, upto) if isinstance(landings, Feed) else landings
        names = [self.feed, self.seq, self.version, self.at]
        for c in names:
            rows = rows.where(F.col(c).isNotNull())
        last = rows.groupBy(self.feed, self.seq).agg(F.max(F.struct(self.at, self.version, *keep)).alias("_r")).select(self.feed, self.seq, *[F.col("_r")[c].alias(c) for c in (self.version, self.at, *keep)])
        frozen, seen = self._layers(last, "last", [*names, *keep]), self._layers(last, "seen", names)
        path = frozen.write(last)
        old = seen.read(state.get("seen", []), frozen.touched(path))
        known = old.groupBy(self.feed, self.seq).agg(F.max(F.struct(self.at, self.version)).alias("_seen"))
        both = frozen.read([path]).join(known, [self.feed, self.seq], "left")
        newer = both.where(F.col("_seen").isNull() | (F.struct(self.at, self.version) > F.col("_seen")))
        fresh = newer.where(F.col("_seen").isNull() | (F.col(f"_seen.{self.version}") != F.col(self.version))).drop("_seen")
        out = self.log.fresh("data")
        (transform(fresh) if transform else fresh).write.parquet(out)
        layers = [*state.get("seen", []), seen.write(newer.select(*names))]
        if len(layers) > LAYERS:
            merged = seen.read(layers).groupBy(self.feed, self.seq).agg(F.max(F.struct(self.at, self.version)).alias("_r"))
            layers = [seen.write(merged.select(self.feed, self.seq, F.col(f"_r.{self.version}").alias(self.version), F.col(f"_r.{self.at}").alias(self.at)))]
        self.log.commit(number, {"data": out, "seen": layers, "upto": upto, "commits_read": upto - mark})
        return self.spark.read.parquet(out)

    def outputs(self) -> list[str]:
        """Paths of all committed runs, in order."""
        return [self.log.read(v)["data"] for v in self.log.versions()]
