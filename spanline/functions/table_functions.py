"""Table functions over intervals, for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

CUT_INTERVAL = """
create or replace temporary function cut_interval(start_us bigint, stop_us bigint, step_us bigint)
returns table (b bigint, e bigint)
return select start_us + i * step_us, least(stop_us, start_us + (i + 1) * step_us)
from (select explode(sequence(0L, greatest(0L, (stop_us - start_us - 1) div step_us))) as i)
"""


class UnionClip:
    """Disjoint union of the sorted intervals of a partition, clipped; takes and gives Arrow batches.

    Whatever the length of the partition, only the interval still open is held.
    """

    def __init__(self) -> None:
        self.open: tuple[int, int] | None = None
        self.bounds: tuple[int | None, int | None] = (None, None)

    def eval(self, table: pa.RecordBatch, low: pa.Array, high: pa.Array) -> Iterator[pa.Table]:
        if not table.num_rows:
            return
        self.bounds = (low[0].as_py(), high[0].as_py())
        self.key = table.column("span_key")[0].as_py()
        b, e = table.column("b"), table.column("e")
        whole = b.is_valid().to_numpy(zero_copy_only=False) & e.is_valid().to_numpy(zero_copy_only=False)
        b = b.fill_null(0).to_numpy(zero_copy_only=False)[whole]
        e = e.fill_null(0).to_numpy(zero_copy_only=False)[whole]
        if self.open is not None:
            b, e = np.concatenate([[self.open[0]], b]), np.concatenate([[self.open[1]], e])
        if not len(b):
            return
        reach = np.maximum.accumulate(e)
        first = np.flatnonzero(np.concatenate([[True], b[1:] > reach[:-1]]))
        begins, ends = b[first], reach[np.concatenate([first[1:] - 1, [len(b) - 1]])]
        self.open = (int(begins[-1]), int(ends[-1]))
        yield from self._clipped(begins[:-1], ends[:-1])

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None:
            yield from self._clipped(np.array([self.open[0]]), np.array([self.open[1]]))

    def _clipped(self, begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.Table]:
        low, high = self.bounds
        begins = begins if low is None else np.maximum(begins, low)
        ends = ends if high is None else np.minimum(ends, high)
        kept = begins <= ends
        if kept.any():
            keys = pa.array([self.key] * int(kept.sum()), pa.int64())
            yield pa.table({"span_key": keys, "b": begins[kept], "e": ends[kept]})


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL.

    ``cut_interval(b, e, step)``: pieces of at most ``step`` of one interval.

    ``union_clip(TABLE(t) PARTITION BY span_key ORDER BY b, e, low, high)``: the union of the
    intervals ``(span_key, b, e)`` of each key, touching ones joined, cut to ``[low, high]``;
    a null bound does not cut, intervals without begin or end are left out.  Spark partitions
    and sorts; a key is walked by one task in constant memory (``intervals.union_intervals``
    also spreads a key that dominates its table).
    """
    spark.sql(CUT_INTERVAL)
    shape = "span_key bigint, b bigint, e bigint"
    spark.udtf.register("union_clip", arrow_udtf(UnionClip, returnType=shape))
