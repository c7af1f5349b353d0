"""Ranks of all rows of a table by a composite key: least-significant-digit radix sort.

A key is two columns of 64 bits, ``hi`` before ``lo``, both without sign.  Each pass sorts
by one digit and keeps the order of the pass before: rows stand in stretches of equal size;
rows are counted by stretch and digit; running totals over (digit, stretch) say where the
rows of each begin; a row's place is that plus the rows of its digit ahead of it in its
stretch.  Stretches are of equal size whatever the keys are, so no value is a hot one.

Bits that are the same in all rows need no pass.  What is held at once is one stretch in a
task; no rows go to the driver.  Each pass is stored before the next.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.llm.common import Shared, running_total

#: Bits of a digit, rows of a stretch at most.
WIDTH, STRETCH = 12, 1 << 18


def digits(varying: int) -> list[int]:
    """Lowest bits of the digits that cover the bits set in ``varying``."""
    out, bit = [], 0
    while varying >> bit:
        if varying >> bit & 1:
            out.append(bit)
            bit += WIDTH
        else:
            bit += 1
    return out


def _destinations(rows: pa.Table, starts: pa.Table) -> pa.Table:
    """Counting sort of one stretch."""
    begin = np.zeros(1 << WIDTH, np.int64)
    begin[starts.column("digit").to_numpy()] = starts.column("start").to_numpy()
    order = np.argsort(rows.column("pos").to_numpy(), kind="stable")
    digit = rows.column("d").to_numpy()[order].astype(np.uint16)
    by = np.argsort(digit, kind="stable")
    digit, order = digit[by], order[by]
    counts = np.bincount(digit, minlength=1 << WIDTH)
    inside = np.arange(len(digit)) - (np.cumsum(counts) - counts)[digit]
    return rows.select(["row", "hi", "lo"]).take(pa.array(order)).append_column("pos", pa.array(begin[digit] + inside))


def ranks(rows: DataFrame, shared: Shared, stretch: int = STRETCH) -> DataFrame:
    """``row, pos`` for a stored table ``row, hi, lo`` of bigints; ``pos`` from 0 by (hi, lo)."""
    bits = [f(c) for c in ("lo", "hi") for f in (F.bit_or, F.bit_and)]
    n, *seen = rows.agg(F.count(F.lit(1)), *bits).first()
    if not n:
        return rows.select("row", F.col("row").alias("pos"))
    # at least as many stretches as tasks
    parts = min(n, max(ceil(n / stretch), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = ceil(n / parts)

    def digit(name: str, bit: int) -> Column:
        return F.shiftrightunsigned(name, bit).bitwiseAND((1 << WIDTH) - 1).cast("int")

    passes = [
        (name, bit)
        for k, name in enumerate(("lo", "hi"))
        for bit in digits((seen[2 * k] ^ seen[2 * k + 1]) & (1 << 64) - 1)
    ]
    at = rows.select("row", "hi", "lo", F.col("row").alias("pos"), F.pmod(F.xxhash64("row"), F.lit(parts)).alias("p"))
    for step, (name, bit) in enumerate(passes or [("lo", 0)]):
        here = at.withColumn("d", digit(name, bit))
        counts = here.groupBy(F.col("p").alias("part"), F.col("d").alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        starts = running_total(counts, [], F.col("digit"), ["part"], F.col("n"), "start")
        starts = starts.select(F.col("part").alias("in"), "digit", "start")
        placed = here.groupBy("p").cogroup(starts.groupBy("in")).applyInArrow(
            _destinations, "row bigint, hi bigint, lo bigint, pos bigint"
        )
        at = shared.keep(placed.withColumn("p", F.floor(F.col("pos") / each)), f"pass-{step}")
        if step:
            shared.drop(f"pass-{step - 1}")
    return at.select("row", "pos")
