"""What a session can be given by name: functions for SQL, packing policies, checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.functions import text
from millrace.operators import packing

#: Policies by name; a new one takes items and a capacity.
POLICIES = {
    "pad_only": packing.pad_only,
    "concat_chop": packing.concat_chop,
    "greedy": packing.greedy,
    "best_fit": packing.best_fit,
    "structure_preserving": packing.alone,
    "long_context": packing.long_context,
}


@udtf(returnType="piece int, at int, length int")
class SplitAtBoundaries:
    """Pieces of an item of ``size``, cut at the last of its points that fits
    the capacity; nothing for a null size, capacity or list."""

    def eval(self, size: int, points: list[int], capacity: int) -> Iterator[tuple[int, int, int]]:
        if size is not None and points is not None and capacity:
            for k, (at, n) in enumerate(packing.cut_at(size, sorted(points), capacity)):
                yield k, at, n


def register(spark: SparkSession) -> None:
    """normalize_nfc(text) and split_at_boundaries(size, points, capacity) for
    SQL, in this session."""
    spark.udf.register("normalize_nfc", text.nfc)
    spark.udtf.register("split_at_boundaries", SplitAtBoundaries)
