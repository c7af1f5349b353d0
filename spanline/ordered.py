"""Ordered scans over timelines that stay parallel when one timeline is huge.

Every operator of the library that looks at neighbouring rows (previous value,
running maximum, last seen value, ...) states what it needs as *steps* and hands
them to :func:`scan`.  There are two plans for the same result:

* when a count shows that the largest timeline fits one task, the steps are
  plain window functions over ``PARTITION BY keys ORDER BY order``; successive
  scans share one exchange and one sort;
* otherwise the timelines over the limit, and only those, are range-partitioned on
  ``(keys, order)``, so that one holding a third of all rows is spread over many
  pieces.  Steps run inside the pieces, one edge row per piece is carried across
  pieces, and the carry is joined back.  Piece numbers are frozen by a reliable
  checkpoint before they are used twice, so a lost executor cannot change them; scans
  that follow each other share the pieces.  All other timelines take the first plan.

Tables of many rows a core are dealt to tasks of about ``TASK_ROWS`` rows in the first
plan: the sorts of a chain all live in one task, and Spark alone would deal a large table to
as many tasks as there are cores.

Nothing is dropped, capped or sampled in either plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spanline.session import cut_lineage, max_group_rows

MAX_HOT_KEYS = 100_000
#: Rows a task should hold; fixed here, so that memory per task does not grow with the table.
TASK_ROWS = 100_000
_PIECE = "_piece"
_FIRST = "_piece_first"
_LAST = "_piece_last"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of about ``TASK_ROWS`` rows, or 0 where the cores have fewer each."""
    if rows <= TASK_ROWS * spark.sparkContext.defaultParallelism:
        return 0
    return math.ceil(rows / TASK_ROWS)


def deal(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Deal rows by key; Spark leaves out a second dealing by the same keys and number."""
    return df.repartition(tasks, *keys) if tasks and keys else df


@dataclass(frozen=True)
class Layout:
    """How big the timelines of a table are; decides the plan of a scan."""

    split: bool
    pieces: int = 1
    keys: tuple[str, ...] = ()
    hot: DataFrame | None = None  # keys of the timelines over the limit
    tasks: int = 0  # tasks to deal a large table to; 0 leaves it to Spark

    @staticmethod
    def inspect(df: DataFrame, keys: Sequence[str]) -> "Layout":
        """Count rows per key (map-side combined) and compare with the limit."""
        one = F.count(F.lit(1)).alias("n")
        return Layout.of_sizes(df.groupBy(*keys).agg(one) if keys else df.agg(one))

    @staticmethod
    def largest(df: DataFrame, keys: Sequence[str]) -> int:
        """Rows of the largest group."""
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.max("n")).first()[0] or 0

    @staticmethod
    def of_sizes(sizes: DataFrame) -> "Layout":
        """Decide from a table with one row per group and its row count ``n``."""
        spark = sizes.sparkSession
        limit = max_group_rows(spark)
        over = F.when(F.col("n") > limit, F.col("n"))
        row = sizes.agg(
            F.count(over).alias("groups"), F.sum(over).alias("rows"), F.sum("n").alias("all")
        ).first()
        tasks = tasks_for(spark, row["all"] or 0)
        if not row["groups"]:
            return Layout(False, tasks=tasks)
        # pieces of the hot rows alone, a few for each core at most
        pieces = min(math.ceil(2 * row["rows"] / limit), 8 * spark.sparkContext.defaultParallelism)
        keys = tuple(c for c in sizes.columns if c != "n")
        # beyond that many, all timelines go through pieces
        named = keys and row["groups"] <= MAX_HOT_KEYS
        hot = cut_lineage(sizes.filter(F.col("n") > limit).select(*keys)) if named else None
        return Layout(True, max(2, pieces), keys, hot, tasks)


class Step:
    """One value wanted per row.  ``expr`` is a column expression of the input."""

    def __init__(self, expr: str | Column):
        self.expr = F.col(expr) if isinstance(expr, str) else expr

    def whole(self, fwd: WindowSpec, back: WindowSpec) -> Column:
        raise NotImplementedError

    def edge(self, name: str) -> dict[str, Column]:
        """Columns to keep on the edge row of a piece."""
        raise NotImplementedError

    def carry(self, name: str, w: WindowSpec) -> Column:
        raise NotImplementedError

    def merged(self, name: str) -> Column:
        raise NotImplementedError

    def local(self, name: str, fwd: WindowSpec, back: WindowSpec) -> dict[str, Column]:
        return {name: self.whole(fwd, back), f"{name}__v": self.expr}


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


class Prev(Step):
    """Value of the row before (NULL on the first row)."""

    def whole(self, fwd, back):
        return F.lag(self.expr).over(fwd)

    def edge(self, name):
        return {f"{name}__t": F.max_by(F.col(f"{name}__v"), F.when(F.col(_LAST), 1))}

    def carry(self, name, w):
        return F.lag(f"{name}__t").over(w)

    def merged(self, name):
        return F.when(F.col(_FIRST), F.col(f"{name}__c")).otherwise(F.col(name))


class Next(Step):
    """Value of the row after (NULL on the last row)."""

    def whole(self, fwd, back):
        return F.lead(self.expr).over(fwd)

    def edge(self, name):
        return {f"{name}__t": F.max_by(F.col(f"{name}__v"), F.when(F.col(_FIRST), 1))}

    def carry(self, name, w):
        return F.lead(f"{name}__t").over(w)

    def merged(self, name):
        return F.when(F.col(_LAST), F.col(f"{name}__c")).otherwise(F.col(name))


class RunSum(Step):
    """Sum over all rows up to this one."""

    def whole(self, fwd, back):
        return F.sum(self.expr).over(_upto(fwd))

    def edge(self, name):
        return {f"{name}__t": F.max_by(F.col(name), F.when(F.col(_LAST), 1))}

    def carry(self, name, w):
        return F.sum(f"{name}__t").over(_before(w))

    def merged(self, name):
        c, v = F.col(f"{name}__c"), F.col(name)
        return F.when(c.isNull(), v).when(v.isNull(), c).otherwise(c + v)


class RunMax(RunSum):
    """Maximum over all rows up to this one."""

    def whole(self, fwd, back):
        return F.max(self.expr).over(_upto(fwd))

    def carry(self, name, w):
        return F.max(f"{name}__t").over(_before(w))

    def merged(self, name):
        return F.greatest(F.col(f"{name}__c"), F.col(name))


class GroupMax(Step):
    """Maximum over all rows of the group."""

    def whole(self, fwd, back):
        return F.greatest(F.max(self.expr).over(_upto(fwd)), F.max(self.expr).over(_upto(back)))

    def edge(self, name):
        return {f"{name}__t": F.max(F.col(name))}

    def carry(self, name, w):
        return F.max(f"{name}__t").over(
            w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )

    def merged(self, name):
        return F.col(f"{name}__c")


class MaxBefore(Step):
    """Maximum over all rows before this one."""

    def whole(self, fwd, back):
        return F.max(self.expr).over(_before(fwd))

    def edge(self, name):
        last = F.when(F.col(_LAST), 1)
        return {f"{name}__t": F.max_by(F.greatest(F.col(name), F.col(f"{name}__v")), last)}

    def carry(self, name, w):
        return F.max(f"{name}__t").over(_before(w))

    def merged(self, name):
        return F.greatest(F.col(f"{name}__c"), F.col(name))


class LastValue(Step):
    """Last non-null value up to and including this row."""

    def whole(self, fwd, back):
        return F.last(self.expr, ignorenulls=True).over(_upto(fwd))

    def edge(self, name):
        return {f"{name}__t": F.max_by(F.col(name), F.when(F.col(_LAST), 1))}

    def carry(self, name, w):
        return F.last(f"{name}__t", ignorenulls=True).over(_before(w))

    def merged(self, name):
        return F.coalesce(F.col(name), F.col(f"{name}__c"))


class NextValue(Step):
    """First non-null value at or after this row."""

    def whole(self, fwd, back):
        # a reversed running frame: linear, unlike a frame to unbounded following
        return F.last(self.expr, ignorenulls=True).over(_upto(back))

    def edge(self, name):
        return {f"{name}__t": F.max_by(F.col(name), F.when(F.col(_FIRST), 1))}

    def carry(self, name, w):
        # edge rows number at most one per piece, so this frame is small
        return F.first(f"{name}__t", ignorenulls=True).over(
            w.rowsBetween(1, Window.unboundedFollowing)
        )

    def merged(self, name):
        return F.coalesce(F.col(name), F.col(f"{name}__c"))


class LastN(Step):
    """Array of the last ``n`` values up to and including this row, oldest first."""

    def __init__(self, expr: str | Column, n: int):
        super().__init__(expr)
        self.n = n

    def whole(self, fwd, back):
        return F.collect_list(self.expr).over(fwd.rowsBetween(-(self.n - 1), 0))

    def edge(self, name):
        return {f"{name}__t": F.max_by(F.col(name), F.when(F.col(_LAST), 1))}

    def carry(self, name, w):
        return F.flatten(F.collect_list(f"{name}__t").over(w.rowsBetween(-self.n, -1)))

    def merged(self, name):
        both = F.concat(F.coalesce(F.col(f"{name}__c"), F.array()), F.col(name))
        return F.slice(both, F.greatest(F.size(both) - self.n + 1, F.lit(1)), self.n)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Mapping[str, Step],
    layout: Layout | None = None,
    more: bool = False,
) -> DataFrame:
    """Add one column per step, computed along ``order`` inside each ``keys`` group.

    ``more`` says that a scan with the same keys and order follows on the same rows
    (or some of them): a split table then keeps its pieces for it.
    """
    keys, order = list(keys), list(order)
    layout = layout or Layout.inspect(df, keys)
    if not layout.split:
        return _scan_plain(deal(df, keys, layout.tasks), keys, order, steps)
    if _PIECE in df.columns:
        hot = df.filter(F.col(_PIECE).isNotNull())
        rest = df.filter(F.col(_PIECE).isNull())
    elif layout.hot is not None and set(layout.keys) == set(keys):
        marks = F.broadcast(layout.hot.select(*[F.col(k).alias(f"{k}__h") for k in keys]))
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}__h")) for k in keys])
        hot = df.join(marks, on, "left_semi")
        rest = df.join(marks, on, "left_anti").withColumn(_PIECE, F.lit(None).cast("int"))
    else:  # counted on other keys
        return _scan_split(df, keys, order, steps, layout, more)
    done = _scan_plain(deal(rest, keys, layout.tasks), keys, order, steps)
    return _scan_split(hot, keys, order, steps, layout, more).unionByName(
        done if more else done.drop(_PIECE)
    )


def _scan_plain(df, keys, order, steps):
    fwd = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumns({n: s.whole(fwd, back) for n, s in steps.items()})


def _scan_split(df, keys, order, steps, layout, more):
    ranged = _PIECE not in df.columns
    if ranged:
        df = df.repartitionByRange(layout.pieces, *keys, *order).withColumn(
            _PIECE, F.spark_partition_id()
        )
    inside = [_PIECE, *keys]
    fwd = Window.partitionBy(*inside).orderBy(*order)
    back = Window.partitionBy(*inside).orderBy(*[F.col(c).desc() for c in order])
    columns: dict[str, Column] = {
        _FIRST: F.row_number().over(fwd) == 1,
        _LAST: F.lead(F.lit(1)).over(fwd).isNull(),
    }
    for name, step in steps.items():
        columns.update(step.local(name, fwd, back))
    local = df.withColumns(columns)
    if ranged or more:
        # Fixes the piece numbers, and keeps a chain of scans from recomputing itself.
        # The last scan of a chain is derived twice from its checkpoint, without a shuffle.
        local = cut_lineage(local)

    kept: dict[str, Column] = {}
    for name, step in steps.items():
        kept.update(step.edge(name))
    edges = (
        local.filter(F.col(_FIRST) | F.col(_LAST))
        .groupBy(*inside)
        .agg(*[c.alias(n) for n, c in kept.items()])
    )
    across = Window.partitionBy(*keys).orderBy(_PIECE)
    carries = edges.select(
        *[F.col(c).alias(f"{c}__k") for c in inside],
        *[step.carry(name, across).alias(f"{name}__c") for name, step in steps.items()],
    )
    on = F.lit(True)
    for c in inside:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}__k"))
    joined = local.join(carries, on, "left")
    out = joined.withColumns({n: s.merged(n) for n, s in steps.items()})
    names = [c for c in df.columns if more or c != _PIECE]
    return out.select(*names, *steps)


def nearest_rows(
    points: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    t: str,
    at: str,
    *,
    table_first: bool = True,
    before: str | None = None,
    after: str | None = None,
    highest: Mapping[str, Callable[[Column], Column]] | None = None,
    whole: Mapping[str, Callable[[Column], Column]] | None = None,
    tie: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """As-of lookups of ``points`` in ``table`` with one shuffle and one sort.

    ``before`` names a struct column with the last table row ahead of ``t``,
    ``after`` one with the first table row behind it, ``highest`` running
    maxima, given as ``name -> function of the table row``, ``whole`` maxima over the whole
    group.  With ``table_first`` a table row exactly
    at ``t`` counts as before it (``<= t`` and ``> t``), else as after it (``< t``
    and ``>= t``).  ``tie`` orders table rows that share a time.
    """
    keys = list(keys)
    tie_type = table.schema[tie].dataType if tie else LongType()
    tie_col = F.col(tie) if tie else F.lit(0).cast(tie_type)
    left = points.select(
        *keys,
        F.struct(*[F.col(c) for c in points.columns if c not in keys]).alias("_pt"),
        F.col(t).alias("_at"),
        F.lit(1 if table_first else 0).alias("_tag"),
        F.lit(None).cast(tie_type).alias("_tie"),
    )
    right = table.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(0 if table_first else 1).alias("_tag"),
        tie_col.alias("_tie"),
        F.struct(*[F.col(c) for c in table.columns if c not in keys]).alias("_row"),
    )
    steps: dict[str, Step] = {}
    if before:
        steps["_before"] = LastValue("_row")
    if after:
        steps["_after"] = NextValue("_row")
    for name, of_row in (highest or {}).items():
        steps[name] = RunMax(of_row(F.col("_row")))
    for name, of_row in (whole or {}).items():
        steps[name] = GroupMax(F.when(F.col("_row").isNotNull(), of_row(F.col("_row"))))
    rows = left.unionByName(right, allowMissingColumns=True)
    done = scan(rows, keys, ["_at", "_tag", "_tie"], steps, layout)
    extra = []
    if before:
        extra.append(F.col("_before").alias(before))
    if after:
        extra.append(F.col("_after").alias(after))
    extra.extend(F.col(name) for name in [*(highest or {}), *(whole or {})])
    fields = [F.col("_pt")[c].alias(c) for c in points.columns if c not in keys]
    return done.filter(F.col("_pt").isNotNull()).select(*keys, *fields, *extra)
