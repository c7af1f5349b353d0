"""Interval algebra: samples to intervals, smoothing, union, grids.

Intervals are rows ``(keys..., b, e, status)`` in BIGINT microseconds; ``e`` is
the time of the last sample, not an exclusive end.  All sequential work goes
through :func:`spanline.ordered.scan`; merging uses ``groupBy(keys, island)``,
which pre-aggregates before its shuffle and spreads a hot timeline by island.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.ordered import (
    GroupMax,
    LastValue,
    Layout,
    MaxBefore,
    Next,
    Prev,
    RunSum,
    nearest_rows,
    scan,
)

ORDER = ("b", "e")


def _islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    label: str,
    layout: Layout,
    breaks: Column | None = None,
) -> DataFrame:
    """Number runs of equal ``label`` (``breaks`` forces further cuts)."""
    df = scan(df, keys, order, {"_prev": Prev(label), "_seen": Prev(F.lit(1))}, layout, True)
    new = F.col("_seen").isNull() | ~F.col(label).eqNullSafe(F.col("_prev"))
    if breaks is not None:
        new = new | F.coalesce(breaks, F.lit(False))
    df = df.withColumn("_new", new.cast("bigint")).drop("_prev", "_seen")
    return scan(df, keys, order, {"_island": RunSum("_new")}, layout).drop("_new")


def run_length_encode(
    df: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    label: str = "label",
    order: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Samples to ``(keys, b, e, status, n)``: a new interval where the label changes."""
    layout = layout or Layout.inspect(df, keys)
    runs = _islands(df, keys, [t, *order], label, layout)
    # the label is constant in a run; as a grouping column it keeps the aggregate hash-based
    return (
        runs.groupBy(*keys, "_island", F.col(label).alias("status"))
        .agg(F.min(t).alias("b"), F.max(t).alias("e"), F.count(F.lit(1)).alias("n"))
        .select(*keys, "b", "e", "status", "n")
    )


def coalesce_intervals(
    iv: DataFrame,
    keys: Sequence[str],
    origin: int | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Merge neighbours of equal status, taking in the gap between them.

    ``origin`` moves the begin of each group's first interval.
    """
    layout = layout or Layout.inspect(iv, keys)
    out = (
        _islands(iv, keys, ORDER, "status", layout)
        .groupBy(*keys, "_island", "status")
        .agg(F.min("b").alias("b"), F.max("e").alias("e"))
    )
    if origin is not None:
        out = out.withColumn(
            "b", F.when(F.col("_island") == 1, F.lit(origin)).otherwise(F.col("b"))
        )
    return out.select(*keys, "b", "e", "status")


def _limit_for(thresholds: int | Mapping[str, int]) -> Column:
    if isinstance(thresholds, Mapping):
        limit = F.lit(None).cast("bigint")
        for status, us in thresholds.items():
            limit = F.when(F.col("status") == status, F.lit(us)).otherwise(limit)
        return limit
    return F.lit(thresholds).cast("bigint")


def filter_min_duration(
    iv: DataFrame,
    keys: Sequence[str],
    thresholds: int | Mapping[str, int],
    protect_initial: bool = False,
    origin: int | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Drop intervals shorter than their threshold, coalescing before and after.

    Statuses without a threshold stay.  The last interval of a group always
    stays; the first only with ``protect_initial``.
    """
    layout = layout or Layout.inspect(iv, keys)
    merged = coalesce_intervals(iv, keys, origin, layout)
    seen = scan(
        merged, keys, ORDER, {"_p": Prev(F.lit(1)), "_n": Next(F.lit(1))}, layout, True
    )
    keep = (
        _limit_for(thresholds).isNull()
        | (F.col("e") - F.col("b") >= _limit_for(thresholds))
        | F.col("_n").isNull()
    )
    if protect_initial:
        keep = keep | F.col("_p").isNull()
    return coalesce_intervals(seen.filter(keep).drop("_p", "_n"), keys, origin, layout)


def filter_by_rules(
    iv: DataFrame,
    keys: Sequence[str],
    rules: DataFrame,
    protect_initial: bool = False,
    layout: Layout | None = None,
) -> DataFrame:
    """:func:`filter_min_duration` with thresholds as a table ``(status, min_us)``."""
    layout = layout or Layout.inspect(iv, keys)
    merged = coalesce_intervals(iv, keys, None, layout)
    seen = scan(
        merged, keys, ORDER, {"_p": Prev(F.lit(1)), "_n": Next(F.lit(1))}, layout
    ).join(rules.select("status", "min_us"), "status", "left")
    keep = (
        F.col("min_us").isNull()
        | (F.col("e") - F.col("b") >= F.col("min_us"))
        | F.col("_n").isNull()
    )
    if protect_initial:
        keep = keep | F.col("_p").isNull()
    kept = seen.filter(keep).select(*keys, "b", "e", "status")
    return coalesce_intervals(kept, keys, None, layout)


def anchor_smooth(
    iv: DataFrame,
    keys: Sequence[str],
    min_us: int,
    ignore: str = "n/a",
    layout: Layout | None = None,
) -> DataFrame:
    """Keep anchors (first row, or longer than ``min_us`` and not ``ignore``).

    Any other row survives only where it continues the status of the last anchor.
    """
    layout = layout or Layout.inspect(iv, keys)
    iv = coalesce_intervals(iv, keys, None, layout)
    iv = scan(iv, keys, ORDER, {"_seen": Prev(F.lit(1))}, layout, True)
    anchor = F.col("_seen").isNull() | (
        (F.col("e") - F.col("b") > min_us) & (F.col("status") != ignore)
    )
    steps = {"_anchor": LastValue(F.when(anchor, F.col("status")))}
    iv = scan(iv, keys, ORDER, steps, layout, True)
    kept = iv.filter(F.col("status") == F.col("_anchor")).drop("_anchor", "_seen")
    return coalesce_intervals(kept, keys, None, layout)


def sandwich_relabel(
    iv: DataFrame,
    keys: Sequence[str],
    rewrites: Sequence[tuple[str, str, str, str]] = (),
    normal: str | None = None,
    drops: Sequence[tuple[str, str]] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Neighbour rules, all judged on the input rows, then coalesced.

    ``rewrites``: ``(before, status, after, new)``.  ``normal``: a zero-length
    interval of another status takes the status of an abnormal successor.
    ``drops``: ``(status, around)`` removes ``status`` between two ``around``.
    """
    layout = layout or Layout.inspect(iv, keys)
    df = scan(iv, keys, ORDER, {"_p": Prev("status"), "_n": Next("status")}, layout)
    p, n, s = F.col("_p"), F.col("_n"), F.col("status")
    drop = F.lit(False)
    for status, around in drops:
        drop = drop | ((s == status) & (p == around) & (n == around))
    new = s
    for before, status, after, to in rewrites:
        new = F.when((p == before) & (s == status) & (n == after), F.lit(to)).otherwise(new)
    if normal is not None:
        new = F.when(
            (s != normal) & (F.col("e") == F.col("b")) & (n != normal), n
        ).otherwise(new)
    kept = df.filter(~F.coalesce(drop, F.lit(False))).withColumn("status", new)
    return coalesce_intervals(kept.select(*keys, "b", "e", "status"), keys, None, layout)


def drop_early(
    iv: DataFrame, keys: Sequence[str], before_us: int, keep: str, layout: Layout | None = None
) -> DataFrame:
    """Remove statuses other than ``keep`` that begin within ``before_us`` of the group's start."""
    df = scan(iv, keys, ["b", "e"], {"_start": GroupMax(-F.col("b"))}, layout)
    return df.filter(
        (F.col("status") == keep) | (F.col("b") + F.col("_start") >= before_us)
    ).drop("_start")


def snap_begin(
    iv: DataFrame,
    keys: Sequence[str],
    max_gap: int | None,
    tick: int,
    layout: Layout | None = None,
) -> DataFrame:
    """Begin := previous end + ``tick`` where the gap is below ``max_gap`` (always if None)."""
    df = scan(iv, keys, ORDER, {"_pe": Prev("e")}, layout)
    near = F.col("_pe").isNotNull()
    if max_gap is not None:
        near = near & (F.col("b") - F.col("_pe") < max_gap)
    return df.withColumn(
        "b", F.when(near, F.col("_pe") + tick).otherwise(F.col("b"))
    ).drop("_pe")


def union_intervals(
    iv: DataFrame, keys: Sequence[str], layout: Layout | None = None
) -> DataFrame:
    """Merge overlapping or touching intervals into disjoint ``(keys, b, e)``."""
    layout = layout or Layout.inspect(iv, keys)
    df = scan(iv, keys, ORDER, {"_reach": MaxBefore("e")}, layout, True)
    new = F.col("_reach").isNull() | (F.col("b") > F.col("_reach"))
    df = df.withColumn("_new", new.cast("bigint")).drop("_reach")
    df = scan(df, keys, ORDER, {"_island": RunSum("_new")}, layout)
    return (
        df.groupBy(*keys, "_island")
        .agg(F.min("b").alias("b"), F.max("e").alias("e"))
        .drop("_island")
    )


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    gap: int,
    order: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Number sessions ``_session``: a row more than ``gap`` after the last one opens a new one."""
    layout = layout or Layout.inspect(df, keys)
    o = [t, *order]
    df = scan(df, keys, o, {"_pt": Prev(t)}, layout, True)
    new = F.col("_pt").isNull() | (F.col(t) - F.col("_pt") > gap)
    df = df.withColumn("_new", new.cast("bigint")).drop("_pt")
    return scan(df, keys, o, {"_session": RunSum("_new")}, layout).drop("_new")


def event_ranges(
    events: DataFrame,
    keys: Sequence[str],
    t: str,
    window: int,
    end: int | Column | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """Each event opens ``[t, t + window]``; overlapping windows extend; the last is clamped."""
    out = (
        gap_sessions(events, keys, t, window, layout=layout)
        .groupBy(*keys, "_session")
        .agg(F.min(t).alias("b"), (F.max(t) + window).alias("e"))
        .drop("_session")
    )
    if end is not None:
        stop = end if isinstance(end, Column) else F.lit(end)
        out = out.withColumn("e", F.least(F.col("e"), stop))
    return out


def close_gaps(
    iv: DataFrame,
    keys: Sequence[str],
    min_us: int = 0,
    layout: Layout | None = None,
) -> DataFrame:
    """Long enough statuses, equal ones merged, each end moved to the next begin."""
    layout = layout or Layout.inspect(iv, keys)
    kept = iv.filter(F.col("e") - F.col("b") >= min_us)
    merged = coalesce_intervals(kept, keys, None, layout)
    df = scan(merged, keys, ORDER, {"_nb": Next("b")}, layout)
    return df.withColumn("e", F.coalesce("_nb", "e")).drop("_nb")


def trim_sequences(
    df: DataFrame, b: str = "b", e: str = "e", trim: int = 100_000
) -> DataFrame:
    """Cut ``trim`` off both ends; drop what becomes empty."""
    return (
        df.withColumn(b, F.col(b) + trim)
        .withColumn(e, F.col(e) - trim)
        .filter(F.col(e) > F.col(b))
    )


def clip_window(
    df: DataFrame,
    keys: Sequence[str],
    offset: int,
    length: int,
    b: str = "b",
    e: str = "e",
) -> DataFrame:
    """First long enough sequence per key, cut to ``[b + offset, b + offset + length]``."""
    rest = [c for c in df.columns if c not in keys]
    long = df.filter(F.col(e) - F.col(b) >= offset + length)
    first = long.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(F.col(b), F.col(e))).alias("_r")
    )
    return (
        first.select(*keys, "_r.*")
        .withColumn(e, F.least(F.col(e), F.col(b) + offset + length))
        .withColumn(b, F.col(b) + offset)
    )


def rebase_time(df: DataFrame, parent_b: str, cols: Sequence[str] = ("b", "e")) -> DataFrame:
    """Make times relative to their round's begin."""
    return df.withColumns({c: F.col(c) - F.col(parent_b) for c in cols})


def min_length(
    df: DataFrame, min_us: int, strict: bool = True, b: str = "b", e: str = "e"
) -> DataFrame:
    """Rows longer than ``min_us`` (or at least as long, if not ``strict``)."""
    length = F.col(e) - F.col(b)
    return df.filter(length > min_us if strict else length >= min_us)


BLOCK = 10_000


def _ticks(df: DataFrame, last: Column, out: str) -> DataFrame:
    """Rows times 0..``last``, generated in blocks so that no row holds a long array."""
    n = last.cast("bigint")
    df = df.withColumn("_last", n).withColumn(
        "_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / BLOCK)))
    )
    inside = F.sequence(
        F.col("_blk") * BLOCK, F.least(F.col("_last"), F.col("_blk") * BLOCK + BLOCK - 1)
    )
    return df.withColumn(out, F.explode(inside)).drop("_last", "_blk")


def uniform_grid(
    seqs: DataFrame,
    keys: Sequence[str],
    step_us: int,
    trim_us: int = 100_000,
) -> DataFrame:
    """Ticks every ``step_us`` over each sequence trimmed at both ends."""
    ticks = trim_sequences(seqs.select(*keys, "b", "e"), trim=trim_us)
    return (
        _ticks(ticks, F.floor((F.col("e") - F.col("b")) / step_us), "tick")
        .withColumn("t", F.col("b") + F.col("tick") * step_us)
        .select(*keys, "t", "tick")
    )


def grid_for(grid: DataFrame, every: int) -> DataFrame:
    """Ticks used by a consumer that takes every ``every``-th one of a shared grid."""
    return grid.filter(F.pmod(F.col("tick"), F.lit(every)) == 0)


def _reach_of_step(step: int):
    return lambda row: F.when(row["step_us"] == step, row["e"])


def sampling_grid(
    iv: DataFrame,
    keys: Sequence[str],
    steps: DataFrame,
    base_step_us: int,
    layout: Layout | None = None,
) -> DataFrame:
    """Sample times ``(keys, t)`` at a step per status; the finest step wins overlaps.

    Inside an interval of status ``s`` the points are ``b, b + step, ...`` and the
    interval's end, where the last step would pass it.  Statuses without a row in
    ``steps`` use the base step.  A point of a coarser interval is left out where
    an interval with a finer step covers it.
    """
    stepped = iv.join(steps.select("status", "step_us"), "status", "left").withColumn(
        "step_us", F.coalesce("step_us", F.lit(base_step_us))
    )
    # the tick after the last whole step is pulled back to the interval's end
    last = F.ceil((F.col("e") - F.col("b")) / F.col("step_us"))
    points = _ticks(stepped, last, "_k").select(
        *keys,
        "step_us",
        F.least(F.col("b") + F.col("_k") * F.col("step_us"), F.col("e")).alias("t"),
    )
    # Steps come from a small rules table; one lookup answers "covered by a finer
    # step?" for all of them, without joining points to intervals pairwise.
    sizes = {r[0] for r in steps.select("step_us").distinct().limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 distinct sampling steps")
    finer = sorted(sizes | {base_step_us})[:-1]
    reach = {f"_until{s}": _reach_of_step(s) for s in finer}
    cover = stepped.select(*keys, "b", "e", "step_us")
    if layout is None:
        # grid sizes follow from the intervals; no need to build the grid to count it
        per = F.floor((F.col("e") - F.col("b")) / F.col("step_us")) + 3
        layout = Layout.of_sizes(stepped.groupBy(*keys).agg(F.sum(per).alias("n")))
    looked = nearest_rows(points, cover, keys, "t", "b", highest=reach, layout=layout)
    hidden = F.lit(False)
    for s in finer:
        hidden = hidden | ((F.col("step_us") > s) & (F.col(f"_until{s}") >= F.col("t")))
    points = looked.filter(~F.coalesce(hidden, F.lit(False)))
    return points.select(*keys, "t").distinct()


def chunk_sequences(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    layout: Layout | None = None,
) -> DataFrame:
    """Add ``chunk`` (0-based) and ``pos`` so that each chunk holds ``n`` consecutive rows."""
    df = scan(df, keys, order, {"_rn": RunSum(F.lit(1))}, layout)
    return (
        df.withColumn("chunk", F.floor((F.col("_rn") - 1) / n))
        .withColumn("pos", F.pmod(F.col("_rn") - 1, F.lit(n)))
        .drop("_rn")
    )


def near_boundary(
    iv: DataFrame,
    keys: Sequence[str],
    pad: int,
    inside: str = "game",
    outside: str = "not_game",
    layout: Layout | None = None,
) -> DataFrame:
    """Windows of ``pad`` around changes between ``outside`` and ``inside``.

    An interval opened from ``outside`` gives a window around its begin; else one
    that ends the group or is followed by ``outside`` gives one around its end.
    """
    df = scan(iv, keys, ORDER, {"_p": Prev("status"), "_n": Next("status")}, layout)
    at = F.when(F.col("_p") == outside, F.col("b")).when(
        F.col("_n").isNull() | (F.col("_n") == outside), F.col("e")
    )
    return (
        df.filter(F.col("status") == inside)
        .withColumn("_at", at)
        .filter(F.col("_at").isNotNull())
        .select(*keys, (F.col("_at") - pad).alias("b"), (F.col("_at") + pad).alias("e"))
    )
