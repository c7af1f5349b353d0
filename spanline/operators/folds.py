"""Order-dependent rules as grouped folds over short episodes.

A fold must see its rows in order, so its groups have to stay small.  Callers cut
timelines into *episodes* first: places where no later row can depend on an
earlier one.  Episodes of a hot timeline then spread over all executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanline.ordered import Layout, MaxBefore, RunSum, scan


def episodes(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    begin: str | Column,
    reach: Column,
    layout: Layout | None = None,
    out: str = "_episode",
) -> DataFrame:
    """Cut where a row begins after everything before it has ceased to matter.

    ``reach`` is the time until which a row can influence later ones.
    """
    layout = layout or Layout.inspect(df, keys)
    b = F.col(begin) if isinstance(begin, str) else begin
    df = scan(df, keys, order, {"_reach": MaxBefore(reach)}, layout, True)
    cut = F.col("_reach").isNull() | (b > F.col("_reach"))
    df = df.withColumn("_cut", cut.cast("bigint")).drop("_reach")
    return scan(df, keys, order, {out: RunSum("_cut")}, layout).drop("_cut")


def timeline_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[Iterator[dict]], Iterator[dict]],
    schema: str,
    alone: Column | None = None,
) -> DataFrame:
    """Apply ``fn`` to the ordered rows of each group, taken and given one by one as dicts.

    Spark partitions by group and sorts (spilling if need be); a task then walks its
    sorted Arrow batches.  ``fn`` gives a row as soon as no later one can change it, so a
    group of any length takes no more memory than the rows that are still open.  With
    ``alone`` groups of one row never leave the JVM: they stay where it holds.
    """
    keys = list(keys)
    out_type = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        groups = groupby(rows, key=lambda row: tuple(row[k] for k in keys))
        done = (row for _, group in groups for row in fn(group))
        while block := list(islice(done, 10_000)):
            yield pa.RecordBatch.from_pylist(block, schema=arrow)

    dealt = df.repartition(*keys)
    if alone is None:
        return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, out_type)
    sized = dealt.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    many = sized.filter("_rows > 1").drop("_rows").sortWithinPartitions(*keys, *order)
    one = sized.filter((F.col("_rows") == 1) & alone).select(*out_type.names)
    return many.mapInArrow(run, out_type).unionByName(one)
