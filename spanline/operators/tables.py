"""Projections, filters, top-k and set operations on whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.ordered import Layout, RunSum, scan


def mask_labels(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Force dependent labels by the value of another column.

    ``rules``: ``(when_col, when_val, target, value)``, a small table read on the
    driver (refused over 1,000 rows); the expressions stay in one projection.
    """
    rows = rules.select("when_col", "when_val", "target", "value").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 mask rules")
    by_target: dict[str, Column] = {}
    for r in sorted(rows):
        col = by_target.get(r["target"], F.col(r["target"]))
        by_target[r["target"]] = F.when(
            F.col(r["when_col"]) == r["when_val"], F.lit(r["value"])
        ).otherwise(col)
    return df.withColumns(by_target)


def mask_unknown(
    df: DataFrame, entity: str, targets: Sequence[str], unknown: str = "n/a"
) -> DataFrame:
    """Unknown entity: its dependent labels are unknown too."""
    return df.withColumns(
        {
            c: F.when(F.col(entity) == unknown, F.lit(unknown)).otherwise(F.col(c))
            for c in targets
        }
    )


def hex_to_rgb(col: str | Column) -> Column:
    """``#rrggbb`` to an array of three integers."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array(*[F.conv(F.substring(c, p, 2), 16, 10).cast("int") for p in (2, 4, 6)])


def canonical_color(color: Column, left: Column, right: Column, white: str = "white") -> Column:
    """With one side white, any other color is the other side's."""
    other = F.when(left != white, left).otherwise(right)
    one_white = (left == white) | (right == white)
    return F.when(one_white & (color != white), other).otherwise(color)


def canonical_pair(
    df: DataFrame,
    a: str,
    b: str,
    result: str,
    flipped: Mapping[str, str],
    swap: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Order two names alphabetically; mirror the result and swap paired columns."""
    flip = F.col(a) > F.col(b)
    new = F.col(result)
    for value, mirrored in flipped.items():
        new = F.when(flip & (F.col(result) == value), F.lit(mirrored)).otherwise(new)
    out = {a: F.least(a, b), b: F.greatest(a, b), result: new}
    for x, y in swap:
        out[x] = F.when(flip, F.col(y)).otherwise(F.col(x))
        out[y] = F.when(flip, F.col(x)).otherwise(F.col(y))
    return df.withColumns(out)


def correct_clock(
    df: DataFrame,
    offsets: DataFrame,
    key: str,
    t: str,
    declared: str | None = None,
    actual: str | None = None,
    tolerance: int = 2_000_000,
) -> DataFrame:
    """Subtract the key's offset; without one add how much longer the file is than declared."""
    df = df.join(offsets.select(key, F.col("offset").alias("_off")), key, "left")
    drift = F.lit(0).cast("bigint")
    if declared and actual:
        over = F.col(actual) - F.col(declared)
        drift = F.when(over > tolerance, over).otherwise(drift)
    return df.withColumn(
        t,
        F.when(F.col("_off").isNotNull(), F.col(t) - F.col("_off")).otherwise(F.col(t) + drift),
    ).drop("_off")


def side_code(col: str | Column) -> Column:
    """left / right / neither to L / R / N and back."""
    from spanline.functions.arrays import lookup

    pairs = {"left": "L", "right": "R", "neither": "N", "L": "left", "R": "right", "N": "neither"}
    return lookup(pairs, col, None)


def usable_rounds(
    df: DataFrame, id_col: str, status_col: str, statuses: Sequence[str], min_id: int | None = None
) -> DataFrame:
    """Rounds in one of the annotation statuses, optionally from an id on."""
    keep = F.col(status_col).isin(*statuses)
    if min_id is not None:
        keep = keep & (F.col(id_col) >= min_id)
    return df.filter(keep)


def drop_blank(df: DataFrame, len_col: str) -> DataFrame:
    return df.filter(F.col(len_col) != 1)


def allow_deny(
    df: DataFrame,
    key: str,
    allow: Sequence | None = None,
    deny: Sequence | None = None,
    date: str | None = None,
    until: str | None = None,
    title: str | None = None,
    without: str | None = None,
) -> DataFrame:
    """Id lists, no later dates, no titles with a substring."""
    keep = F.lit(True)
    if allow is not None:
        keep = keep & F.col(key).isin(*allow)
    if deny is not None:
        keep = keep & ~F.col(key).isin(*deny)
    if date and until:
        keep = keep & (F.col(date).cast("date") <= F.lit(until).cast("date"))
    if title and without:
        keep = keep & ~F.col(title).contains(without)
    return df.filter(keep)


def chronological(df: DataFrame, t: str, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(t, *ties)


def top_newest(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    k: int,
    tie: str,
    layout: Layout | None = None,
) -> DataFrame:
    """The newest ``k`` rows per key.

    A rank-limit window keeps ``k`` rows per key and task before the shuffle; for a
    split layout the rank comes from the piecewise scan on reversed time.
    """
    layout = layout or Layout.inspect(df, keys)
    if not layout.split:
        w = Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col(tie).desc())
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
    back = df.withColumns({"_t": -F.col(t), "_i": -F.col(tie)})
    ranked = scan(back, keys, ["_t", "_i"], {"_rn": RunSum(F.lit(1))}, layout)
    return ranked.filter(F.col("_rn") <= k).drop("_rn", "_t", "_i")


def sorted_domain(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("value")).distinct().orderBy("value")


def first_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    layout: Layout | None = None,
) -> DataFrame:
    """First ``n`` rows per key (all keys together if none are given)."""
    if not keys:
        return df.orderBy(*order).limit(n)
    layout = layout or Layout.inspect(df, keys)
    if not layout.split:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    ranked = scan(df, keys, order, {"_rn": RunSum(F.lit(1))}, layout)
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """A fixed pseudo-random order: by hash of id and seed."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def distinct_on(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per ``cols`` by ``order``."""
    from spanline.operators.votes import dedup_by_key

    return dedup_by_key(df, cols, order)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
