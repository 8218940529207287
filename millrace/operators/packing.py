"""Packing documents into windows of a context length, and their masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.shards import role_spans
from millrace.operators.windows import running_sum

#: Share of a long window that a document must fill.
LEAST_FILL = 0.45
#: Documents that one first-fit or best-fit run sees.
PART_ROWS = 20_000


def layout(documents: DataFrame) -> DataFrame:
    """(doc_id, role, graded, tok_start, tok_end): a document's tokens are one
    for its start, for each role span its marker (none for plain text) and its
    words, and one for its end, which is graded."""
    spans = role_spans(documents).select("doc_id", "span_no", "role", "graded", (text.word_count() + (F.col("role") != "text").cast("int")).alias("n"))
    run = Window.partitionBy("doc_id").orderBy("span_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spans.withColumn("tok_end", F.sum("n").over(run) + 1).withColumn("tok_start", F.col("tok_end") - F.col("n"))
    last = placed.groupBy("doc_id").agg(F.max("tok_end").alias("tok_start")).select("doc_id", F.lit("eos").alias("role"), F.lit(True).alias("graded"), "tok_start", (F.col("tok_start") + 1).alias("tok_end"))
    return placed.where("n > 0").select("doc_id", "role", "graded", "tok_start", "tok_end").unionByName(last)


def items(documents: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """(doc_id, lane, size, points, min_context, reserved): what is packed;
    points are the places where role spans begin, but for the first token.
    ``placed`` is the documents' layout if it is there already."""
    spans = (layout(documents) if placed is None else placed).groupBy("doc_id").agg(F.max("tok_end").alias("size"), F.array_sort(F.collect_set(F.when(F.col("tok_start") > 1, F.col("tok_start")))).alias("points"))
    own = documents.select("doc_id", "lane", F.coalesce("min_context", F.lit(0)).alias("min_context"), F.coalesce("reserved", F.lit(False)).alias("reserved"))
    return own.join(spans, "doc_id").select("doc_id", "lane", F.col("size").cast("int").alias("size"), "points", "min_context", "reserved")


def pad_only(rows: DataFrame, capacity: int) -> DataFrame:
    """One document to a window, cut off at the capacity."""
    return rows.select("lane", "doc_id", F.least("size", F.lit(capacity)).alias("length"), F.greatest(F.col("size") - capacity, F.lit(0)).alias("truncated"))


def concat_chop(rows: DataFrame, capacity: int) -> DataFrame:
    """(lane, window, doc_id, offset, length, window_start): each lane's
    documents, in order of their id, as one stream cut into windows. Where a
    document lies follows from the sum of the sizes before it."""
    placed = running_sum(rows.select("lane", "doc_id", F.col("size").cast("long").alias("size")), ["lane"], ["doc_id"], "size", "to", width=None)
    begin = F.col("to") - F.col("size")
    first, last = F.floor(begin / capacity), F.floor((F.col("to") - 1) / capacity)
    cut = placed.where("size > 0").select("lane", "doc_id", begin.alias("begin"), "to", F.explode(F.sequence(first, last)).alias("window"))
    lo = F.greatest(F.col("begin"), F.col("window") * capacity)
    hi = F.least(F.col("to"), (F.col("window") + 1) * capacity)
    return cut.select("lane", "window", "doc_id", (lo - F.col("begin")).alias("offset"), (hi - lo).alias("length"), (lo - F.col("window") * capacity).alias("window_start"))


def cut_at(size: int, points: list[int], capacity: int) -> list[tuple[int, int]]:
    """Pieces (offset, length) of an item: cut at the last point that fits, or
    at the capacity where none does."""
    out, at, k = [], 0, 0
    while size - at > capacity:
        best = None
        while k < len(points) and points[k] <= at + capacity:
            if points[k] > at:
                best = points[k]
            k += 1
        end = best if best is not None else at + capacity
        out.append((at, end - at))
        at = end
    out.append((at, size - at))
    return out


class FirstFit:
    """The first window with enough room, by a tree of the most room below."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.n, self.used = capacity, 1, 0
        while self.n < most:
            self.n *= 2
        self.room = [0] * self.n + [0] * self.n

    def _set(self, window: int, room: int) -> None:
        i = window + self.n
        self.room[i] = room
        while i > 1:
            i //= 2
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def place(self, length: int) -> tuple[int, int]:
        if self.room[1] >= length:
            i = 1
            while i < self.n:
                i = 2 * i if self.room[2 * i] >= length else 2 * i + 1
            window = i - self.n
        else:
            window = self.used
            self.used += 1
            self._set(window, self.capacity)
        room = self.room[window + self.n]
        self._set(window, room - length)
        return window, self.capacity - room


class BestFit:
    """The fullest window with enough room, the earliest of equal ones."""

    def __init__(self, capacity: int, most: int = 0):
        self.capacity, self.used, self.bits = capacity, 0, 0
        self.by_room: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            window = heappop(self.by_room[room])
            if not self.by_room[room]:
                self.bits &= ~(1 << room)
        else:
            room, window = self.capacity, self.used
            self.used += 1
        left = room - length
        heappush(self.by_room.setdefault(left, []), window)
        self.bits |= 1 << left
        return window, self.capacity - room


PLACED = "lane string, part long, window long, doc_id long, offset int, length int, window_start int"


def fitted(rows: DataFrame, capacity: int, rule: Callable, longest_first: bool, part_rows: int = PART_ROWS) -> DataFrame:
    """Pack each lane by a rule that looks at all open windows.

    Such a rule is sequential, so a lane is packed in parts of ``part_rows``
    documents in order of their id; windows are numbered within a part.
    """
    numbered = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), ["lane"], ["doc_id"], "_one", "_place", width=None)
    parted = numbered.select("lane", F.floor((F.col("_place") - 1) / part_rows).alias("part"), "doc_id", "size", "points")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        pieces = [(d, o, n) for d, s, p in zip(group["doc_id"], group["size"], group["points"]) for o, n in cut_at(int(s), [int(x) for x in p], capacity)]
        if longest_first:
            pieces.sort(key=lambda x: (-x[2], x[0], x[1]))
        packer = rule(capacity, len(pieces))
        placed = [(d, o, n, *packer.place(n)) for d, o, n in pieces]
        out = pd.DataFrame(placed, columns=["doc_id", "offset", "length", "window", "window_start"])
        return out.assign(lane=group["lane"].iloc[0], part=group["part"].iloc[0])[["lane", "part", "window", "doc_id", "offset", "length", "window_start"]]

    return parted.groupBy("lane", "part").applyInPandas(run, PLACED)


def greedy(rows: DataFrame, capacity: int) -> DataFrame:
    return fitted(rows, capacity, FirstFit, False)


def best_fit(rows: DataFrame, capacity: int) -> DataFrame:
    return fitted(rows, capacity, BestFit, True)


def alone(rows: DataFrame, capacity: int) -> DataFrame:
    """One document's piece to a window, cut at the places where role spans
    begin: (lane, doc_id, offset, length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(lane, d, o, n) for lane, d, s, p in zip(b["lane"], b["doc_id"], b["size"], b["points"]) for o, n in cut_at(int(s), [int(x) for x in p], capacity)], columns=["lane", "doc_id", "offset", "length"])

    return rows.select("lane", "doc_id", "size", "points").mapInPandas(run, "lane string, doc_id long, offset int, length int")


def long_context(rows: DataFrame, capacity: int) -> DataFrame:
    """As ``alone``, of documents that may and should have so long a window."""
    return alone(rows.where((F.col("min_context") <= capacity) & (F.col("size") >= int(LEAST_FILL * capacity))), capacity)


def put_off(rows: DataFrame, capacity: int) -> DataFrame:
    """The documents that ``long_context`` puts off: they need a longer window
    or fill too little of this one."""
    fits = (F.col("min_context") <= capacity) & (F.col("size") >= int(LEAST_FILL * capacity))
    return rows.where(~F.coalesce(fits, F.lit(False)))


def stats(windows: DataFrame, policy: str, capacity: int, rows: DataFrame, truncated: bool = False, deferred: DataFrame | None = None) -> DataFrame:
    """One row for a policy whose windows are given as (used, pieces).

    rows: what was to be packed. retention is the share of its tokens that lie
    in windows; splits are cuts within documents, crossings places where one
    document follows another in a window; what lies in no window was truncated
    or put off.
    """
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("input"), F.count_if(F.col("size") > 0).alias("documents"))
    off = rows.limit(0) if deferred is None else deferred
    late = off.agg(F.count(F.lit(1)).alias("deferred"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("deferred_tokens"))
    made = windows.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("pieces"), F.lit(0)).cast("long").alias("pieces"), F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("used"), F.coalesce(F.sum(F.col("pieces") - 1), F.lit(0)).cast("long").alias("crossings"))
    # one row each
    one = made.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").join(late.withColumn("_k", F.lit(1)), "_k")
    room = F.col("windows") * capacity
    lost = F.col("input") - F.col("used") - F.col("deferred_tokens")
    return one.select(
        F.lit(policy).alias("policy"), F.lit(capacity).alias("capacity"), "windows", "pieces", F.col("input").alias("input_tokens"), "used", (room - F.col("used")).alias("wasted"),
        F.round(F.try_divide(F.col("used"), room), 6).alias("utilisation"), F.round(F.try_divide(F.col("used"), F.col("input")), 6).alias("retention"),
        (F.lit(0).cast("long") if truncated else F.col("pieces") - (F.col("documents") - F.col("deferred"))).alias("splits"), lost.alias("truncated"), "deferred", "deferred_tokens", "crossings",
    )


def compare(rows: DataFrame, capacity: int, relational: bool = False) -> DataFrame:
    """All policies over the same documents, or those that are relational."""
    by = lambda df, *keys: df.groupBy("lane", *keys).agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("pieces"))
    single = lambda df: df.select(F.col("length").alias("used"), F.lit(1).alias("pieces"))
    out = stats(single(pad_only(rows.where("size > 0"), capacity)), "pad_only", capacity, rows, truncated=True).unionByName(stats(by(concat_chop(rows, capacity), "window"), "concat_chop", capacity, rows))
    if relational:
        return out
    for name, windows in (("greedy", by(greedy(rows, capacity), "part", "window")), ("best_fit", by(best_fit(rows, capacity), "part", "window")), ("structure_preserving", single(alone(rows, capacity)))):
        out = out.unionByName(stats(windows, name, capacity, rows))
    return out.unionByName(stats(single(long_context(rows, capacity)), "long_context", capacity, rows, deferred=put_off(rows, capacity)))


def masks(windows: DataFrame, spans: DataFrame, capacity: int) -> DataFrame:
    """Per window of ``concat_chop``: loss, context and pad positions.

    A position counts for the loss if its token lies in a graded span and is
    not the first of its segment, which has nothing before it.
    """
    graded = spans.where("graded").select("doc_id", "tok_start", "tok_end")
    lo = F.greatest(F.col("tok_start"), F.col("offset") + 1)
    hi = F.least(F.col("tok_end"), F.col("offset") + F.col("length"))
    loss = windows.join(graded, "doc_id").groupBy("lane", "window").agg(F.sum(F.greatest(hi - lo, F.lit(0))).alias("loss"))
    used = windows.groupBy("lane", "window").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("segments"), F.sum(F.col("length") * (F.col("length") + 1) / 2).cast("long").alias("edges"))
    joined = used.join(loss, ["lane", "window"], "left").na.fill(0, ["loss"])
    return joined.select("lane", "window", "segments", "loss", (F.col("used") - F.col("loss")).alias("context"), (capacity - F.col("used")).alias("pad"), "edges")


def samples(windows: DataFrame) -> DataFrame:
    """An id for each window from its segments alone."""
    parts = F.array_sort(F.collect_list(F.struct("window_start", "doc_id", "offset", "length")))
    named = F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["doc_id"].cast("string"), s["offset"].cast("string"), s["length"].cast("string"))), ",")
    return windows.groupBy("lane", "window").agg(F.concat(F.lit("smp-"), F.substring(F.sha2(named, 256), 1, 12)).alias("sample_id"), F.sum("length").alias("used"))


def segment_problems(segments: DataFrame) -> DataFrame:
    """Recorded samples whose segments aren't numbered from 0 on, are empty,
    or don't lie side by side in the window. Duplicate rows count once."""
    one = segments.select("sample_id", "seg_no", "window_start", (F.col("token_end") - F.col("token_start")).alias("n")).distinct()
    order = Window.partitionBy("sample_id").orderBy("seg_no", "window_start", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    checked = one.withColumn("_no", F.row_number().over(order) - 1).withColumn("_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bad = lambda c, name: F.sum(F.coalesce(c, F.lit(True)).cast("int")).alias(name)
    return checked.groupBy("sample_id").agg(F.count(F.lit(1)).alias("segments"), bad(F.col("seg_no") != F.col("_no"), "misnumbered"), bad(F.col("n") <= 0, "empty"), bad(F.col("window_start") != F.col("_at"), "misplaced"))


def position_ids(segments: DataFrame) -> DataFrame:
    """(sample_id, index, segment, position): positions begin anew at each segment."""
    one = segments.select("sample_id", "seg_no", "window_start", (F.col("token_end") - F.col("token_start")).alias("n")).distinct().where("n > 0")
    each = one.select("sample_id", F.col("seg_no").alias("segment"), "window_start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("position"))
    return each.select("sample_id", (F.col("window_start") + F.col("position")).alias("index"), "segment", "position")
