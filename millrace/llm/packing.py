"""Filling containers of a fixed capacity with texts of varying length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers that are open at once in one stream.
OPEN = 256
#: Tokens that one stream packs.
STREAM_TOKENS = 40_000_000


class OpenBins:
    """Best fit over a bounded number of open bins.

    ``bits`` has bit f set if some open bin has f free; the best fit is its
    lowest set bit from the size on. When a new bin is needed and all are
    open, the fullest is closed.
    """

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.next = 0, 0, 0
        self.free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.free[free]
        number = bins.pop()
        if not bins:
            del self.free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item no larger than the capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next
            self.next += 1
        left = free - size
        if left or not size:
            self.free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


PLACES = "piece int, container long, start_pos int, tokens int"


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "tokens", most: int = OPEN, streams: int | None = None) -> DataFrame:
    """(key, piece, container, start_pos, tokens): where every item lies.

    Items larger than the capacity are divided, into full pieces and one rest,
    and no others are. A null size counts as 0; an item of size 0 has one
    piece of 0 tokens in some container. Repeated keys are items each. Items
    are spread by a hash of their key over as many streams as their tokens
    need, so no key or source makes a stream large; within a stream they come
    in the order of that hash. Only the last ``most`` containers of a stream
    may stay unfilled for lack of items. No items give no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    if streams is None:
        total = items.agg(F.sum(size).alias("n")).first()["n"] or 0
        streams = max(1, -(-int(total) // STREAM_TOKENS))
    kind = items.select(key).schema[0].dataType.simpleString()
    dealt = items.select(F.pmod(F.xxhash64(F.col(key)), F.lit(streams)).cast("int").alias("_stream"), F.xxhash64(F.lit(7), F.col(key)).alias("_order"), F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("int").alias(size))
    ordered = dealt.repartition(streams, "_stream").sortWithinPartitions("_stream", "_order", key, size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, stream = None, None
        for batch in batches:
            index, pieces, containers, starts, sizes = [], [], [], [], []
            for i, (s, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                if s != stream:
                    bins, stream = OpenBins(capacity, most), s
                piece = 0
                while True:
                    part = min(n, capacity)
                    number, start = bins.place(part)
                    index.append(i)
                    pieces.append(piece)
                    containers.append((s << 40) | number)
                    starts.append(start)
                    sizes.append(part)
                    n -= part
                    piece += 1
                    if n <= 0:
                        break
            keys = batch.column(2).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, t) for v, t in ((pieces, pa.int32()), (containers, pa.int64()), (starts, pa.int32()), (sizes, pa.int32())))], names=["k", "piece", "container", "start_pos", "tokens"])

    return ordered.mapInArrow(work, f"k {kind}, {PLACES}").withColumnRenamed("k", key)


def fill(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens and the share of space filled."""
    each = placed.groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return each.agg(
        F.lit(capacity).alias("capacity"),
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("filled"),
    )
