"""References to records that don't exist, kept up to date batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.commitlog import CommitLog
from millrace.operators.joins import skew_join
from millrace.operators.layers import LAYERS, Layers
from millrace.session import use_checkpoints

REFS = "ref_field string, ref_key string, owner string, seq long, at timestamp"
PARENTS = "ref_field string, ref_key string, first_at timestamp, gone_at timestamp"


def parent_index(parents: DataFrame) -> DataFrame:
    """One row per (ref_field, ref_key): when the key first existed, and when
    its last copy was deleted (null while a copy is there)."""
    kept = F.max(F.col("gone_at").isNull().cast("int"))
    return parents.groupBy("ref_field", "ref_key").agg(F.min("first_at").alias("first_at"), F.when(kept == 0, F.max("gone_at")).alias("gone_at"))


def probe(refs: DataFrame, index: DataFrame, rows: int | None = None) -> DataFrame:
    """refs with ref_state: missing, late, deleted, or null if all is well.

    ``late``: the key first existed after the reference was recorded.
    ``deleted``: it did not come late but was gone by then. Comparisons with a
    null instant are no orphan.
    """
    keyed = refs.withColumn("_key", F.concat_ws("\x01", "ref_field", "ref_key"))
    there = index.select(F.concat_ws("\x01", "ref_field", "ref_key").alias("_key"), "first_at", "gone_at", F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("first_at") > F.col("at"), "late").when(F.col("gone_at") <= F.col("at"), "deleted")
    return skew_join(keyed, there, "_key", rows=rows).select("ref_field", "ref_key", "owner", "seq", "at", state.alias("ref_state"))


def clean_refs(refs: DataFrame) -> DataFrame:
    """Null and empty keys are no references."""
    return refs.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))


def advance(old_refs: DataFrame | None, old_parents: DataFrame | None, old_open: DataFrame | None, new_refs: DataFrame, new_parents: DataFrame) -> DataFrame:
    """The open orphans after a batch, as one plan.

    New references probe the parent index. Arriving and deleted parents (both
    are rows of ``new_parents``) make the references to their keys be probed
    again: waiting ones resolve, settled ones reopen. All others are carried
    over without being looked at. Repeated rows of a batch, or rows of an
    earlier batch again, change nothing. Empty inputs are allowed.
    """
    if old_open is None:
        refs = clean_refs(new_refs).dropDuplicates(["ref_field", "owner", "seq", "ref_key"])
        return probe(refs, parent_index(new_parents)).where(F.col("ref_state").isNotNull())
    return _advance(old_refs, old_parents.unionByName(new_parents), old_open, new_refs, new_parents)


def _advance(old_refs: DataFrame, parents: DataFrame, old_open: DataFrame, new_refs: DataFrame, came: DataFrame) -> DataFrame:
    """advance, with all parents together and those that came or went again."""
    one = ["ref_field", "owner", "seq", "ref_key"]
    touched = came.select("ref_field", "ref_key").distinct()
    again = old_refs.join(touched, ["ref_field", "ref_key"], "left_semi")
    due = again.unionByName(clean_refs(new_refs)).dropDuplicates(one)
    rows = None
    if due.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        # looked at five times below
        due = due.checkpoint()
        rows = due.count()
    needed = due.select("ref_field", "ref_key").distinct()
    index = parent_index(parents.join(needed, ["ref_field", "ref_key"], "left_semi"))
    seen = due.select(*[F.col(c).alias(f"_{c}") for c in one])
    still = old_open.join(seen, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in one)), "left_anti")
    return still.unionByName(probe(due, index, rows).where(F.col("ref_state").isNotNull()))


def counts(open_refs: DataFrame) -> DataFrame:
    """Orphans per field, state and day of the reference."""
    return open_refs.groupBy("ref_field", F.to_date("at").alias("day"), "ref_state").agg(F.count(F.lit(1)).alias("orphans"))


class PendingOrphans:
    """The state of ``advance`` in a shared folder.

    References and the copies of parents are kept by buckets of their key, in
    a layer for every batch; the open orphans are rewritten. A batch reads only
    the buckets that it touches: those of keys whose parents came or went, for
    the references to them, and those of all keys to be probed, for their
    parents. After LAYERS batches the layers are merged into one, in which a
    copy of a parent is one row. Each batch commits layers, open orphans and a
    snapshot of the counts in one manifest, so a batch that fails can simply
    be given again. A deletion is a parent row with ``gone_at`` set; it stands
    for all earlier rows of its key that have the same ``first_at``.
    """

    def __init__(self, spark: SparkSession, root: str):
        use_checkpoints(spark)
        self.spark, self.log = spark, CommitLog(spark, root)
        self.refs, self.parents = (Layers(self.log, kind, ["ref_field", "ref_key"], schema) for kind, schema in (("refs", REFS), ("parents", PARENTS)))

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _copies(parents: DataFrame) -> DataFrame:
        return parents.groupBy("ref_field", "ref_key", "first_at").agg(F.max("gone_at").alias("gone_at"))

    def batch(self, new_refs: DataFrame, new_parents: DataFrame) -> DataFrame:
        """Take rows into the state; the open orphans after them."""
        version, state = self.log.latest()
        open_at, counts_at = self.log.fresh("open"), self.log.fresh("counts")
        refs_at, parents_at = self.refs.write(clean_refs(new_refs)), self.parents.write(new_parents)
        layers = {"refs": [*state.get("refs", []), refs_at], "parents": [*state.get("parents", []), parents_at]}
        refs, came = self.refs.read([refs_at]), self.parents.read([parents_at])
        if not state:
            after, read = advance(None, None, None, refs, self._copies(came)), {}
        else:
            theirs = self.parents.touched(parents_at)
            due = self.parents.touched(refs_at, parents_at)
            known = self._copies(self.parents.read(layers["parents"], due))
            after = _advance(self.refs.read(state["refs"], theirs), known, self.open(), refs, came)
            read = {"refs": len(theirs), "parents": len(due)}
        after.write.parquet(open_at)
        found = self._read([open_at], f"{REFS}, ref_state string")
        counts(found).write.parquet(counts_at)
        if len(layers["refs"]) > LAYERS:
            layers = {"refs": [self.refs.write(self.refs.read(layers["refs"]))], "parents": [self.parents.write(self._copies(self.parents.read(layers["parents"])))]}
        self.log.commit(version, {**layers, "open": open_at, "counts": counts_at, "buckets_read": read})
        return found

    def open(self) -> DataFrame:
        """The open orphans after the latest batch."""
        return self._read([self.log.latest()[1]["open"]], f"{REFS}, ref_state string")

    def snapshot(self) -> DataFrame:
        """Their counts, as committed with that batch."""
        return self._read([self.log.latest()[1]["counts"]], "ref_field string, day date, ref_state string, orphans long")

    def snapshots(self) -> DataFrame:
        """The counts of every batch, with its number."""
        each = [self._read([self.log.read(v)["counts"]], "ref_field string, day date, ref_state string, orphans long").withColumn("batch", F.lit(v)) for v in self.log.versions()]
        return reduce(DataFrame.unionByName, each)


def ledger_refs(learning: DataFrame) -> DataFrame:
    """References of the learning records, one row per record and field,
    taken from a record's latest landing."""
    last = learning.groupBy("branch_id", "seq").agg(F.max(F.struct("landed_at", "recorded_at", F.col("payload.opus_decision_id").alias("opus_decision_id"), F.col("payload.checkpoint_before").alias("checkpoint_before"))).alias("r"))
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f"r.{f}").alias("ref_key")) for f in ("opus_decision_id", "checkpoint_before")]))
    return last.select(pair.alias("p"), "branch_id", "seq", "r").select("p.ref_field", "p.ref_key", F.col("branch_id").alias("owner"), "seq", F.col("r.recorded_at").alias("at"))


def ledger_parents(decisions: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The rows that learning records can refer to."""
    d = decisions.select(F.lit("opus_decision_id").alias("ref_field"), F.col("decision_id").alias("ref_key"), F.col("recorded_at").alias("first_at"), F.lit(None).cast("timestamp").alias("gone_at"))
    c = checkpoints.select(F.lit("checkpoint_before").alias("ref_field"), F.col("checkpoint_id").alias("ref_key"), F.col("saved_at").alias("first_at"), F.col("deleted_at").alias("gone_at"))
    return d.unionByName(c).where(F.col("ref_key").isNotNull())
