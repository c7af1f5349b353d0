"""Votes, shares, weights and counts.

Votes aggregate on (keys, value) first, so a hot key is combined on the map side
and what is ranked afterwards is one row per key and value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.ordered import Layout, scan
from spanline.ordered import Next, RunSum
from spanline.session import cut_lineage


def duration_mode(
    iv: DataFrame, keys: Sequence[str], exclude: str = "n/a", status: str = "status"
) -> DataFrame:
    """Status with the largest summed duration; first seen wins ties."""
    per = (
        iv.filter(F.col(status) != exclude)
        .groupBy(*keys, status)
        .agg(F.sum(F.col("e") - F.col("b")).alias("dur"), F.min("b").alias("_seen"))
    )
    best = F.max_by(
        F.struct(status, "dur"), F.struct(F.col("dur"), -F.col("_seen"))
    )
    return per.groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.*")


def majority_vote(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]
) -> DataFrame:
    """Most frequent value; first seen (lowest ``order``) wins ties."""
    per = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.struct(*order)).alias("_seen")
    )
    # fewest missing votes first, then first seen: one minimum, no ranking sort
    best = F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), F.col("_seen")))
    return per.groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.*")


def roster_vote(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    roster: DataFrame,
    order: Sequence[str],
) -> DataFrame:
    """First seen value that is in the roster, else the most frequent one."""
    per = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.struct(*order)).alias("_seen")
    )
    known = roster.select(value).distinct().withColumn("_in", F.lit(True))
    per = per.join(known, value, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    rank = F.struct(
        ~F.col("_in"),
        F.when(F.col("_in"), F.lit(0)).otherwise(-F.col("votes")),
        F.col("_seen"),
    )
    best = F.min_by(F.struct(value, "votes", F.col("_in").alias("in_roster")), rank)
    return per.groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.*")


def side_vote(
    df: DataFrame, keys: Sequence[str], side: str, hit_one: str | Column, hit_two: str | Column
) -> DataFrame:
    """Whether team one is on the left: its roster hits there exceed team two's."""
    one = F.col(hit_one) if isinstance(hit_one, str) else hit_one
    two = F.col(hit_two) if isinstance(hit_two, str) else hit_two
    left = F.col(side) == "left"
    return df.groupBy(*keys).agg(
        F.sum((left & one).cast("bigint")).alias("left_one"),
        F.sum((left & two).cast("bigint")).alias("left_two"),
    ).withColumn("team_one_left", F.col("left_one") > F.col("left_two"))


def order_statistic(df: DataFrame, value: str, k: int, bits: int = 12) -> int | None:
    """The ``k``-th smallest (from 0) of a column of whole numbers.

    A histogram of ``2 ** bits`` equal ranges finds the range that holds it, the next one
    narrows that range, until it is one number; only such counts reach the driver.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    while low is not None and low < high:
        shift = max(0, (high - low).bit_length() - bits)
        inside = df.filter(F.col(value).between(low, high))
        ranges = inside.groupBy(F.shiftright(F.col(value) - F.lit(low), shift).alias("r")).count()
        for r in sorted(ranges.collect()):
            if k < r["count"]:
                low += r["r"] << shift
                high = min(high, low + (1 << shift) - 1)
                break
            k -= r["count"]
    return low


def play_time(iv: DataFrame, status: str = "status") -> DataFrame:
    """Summed duration per status, the upper median of the sums, and median / sum."""
    per = cut_lineage(iv.groupBy(status).agg(F.sum(F.col("e") - F.col("b")).alias("dur")))
    n = per.agg(F.count("dur")).first()[0]
    median = order_statistic(per.filter("dur is not null"), "dur", n // 2)
    return per.withColumn("median", F.lit(median).cast("bigint")).withColumn("ratio", F.col("median") / F.col("dur"))


def share_of_total(
    df: DataFrame, keys: Sequence[str], category: str, value: str
) -> DataFrame:
    """Each category's part of its key's total; repeated categories are added up."""
    per = df.groupBy(*keys, category).agg(F.sum(value).alias(value))
    total = F.sum(value).over(Window.partitionBy(*keys))
    return per.withColumn("share", F.col(value) / total)


def mean_with_zero_fill(
    df: DataFrame, row_key: Sequence[str], category: str, value: str
) -> DataFrame:
    """Mean of ``value`` per category over all row keys, absent ones counting zero."""
    n_rows = df.select(*row_key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    per = df.groupBy(category).agg(F.sum(value).alias("_s"))
    return (
        per.crossJoin(F.broadcast(n_rows))
        .select(category, (F.col("_s") / F.col("_n")).alias("mean"))
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, value, n)`` for several columns in one pass."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                for c in cols
            ]
        )
    )
    return (
        df.select(pairs.alias("_p"))
        .groupBy("_p.col", "_p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bucket_rare(
    df: DataFrame, cols: Sequence[str], min_count: int, other: str = "unknown"
) -> DataFrame:
    """Replace values seen fewer than ``min_count`` times over all ``cols`` together."""
    if min_count <= 0:
        return df
    values = df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("_v"))
    rare = (
        values.groupBy("_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") < min_count)
    )
    out = df
    for c in cols:
        mark = rare.select(F.col("_v").alias(c), F.lit(True).alias("_rare"))
        out = (
            out.join(mark, c, "left")
            .withColumn(c, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(c)))
            .drop("_rare")
        )
    return out.select(*df.columns)


def class_weights(
    df: DataFrame, label: str, vocab: DataFrame, cap: int = 1000
) -> DataFrame:
    """``total / count`` capped, zero for vocabulary labels never seen."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    known = vocab.select(label).distinct().join(counts, label, "left")
    return (
        known.crossJoin(F.broadcast(total))
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn(
            "weight",
            F.when(F.col("n") == 0, F.lit(0.0)).otherwise(
                F.least(F.col("_total") / F.col("n"), F.lit(float(cap)))
            ),
        )
        .drop("_total")
    )


def sequence_weights(df: DataFrame, seq: str) -> DataFrame:
    """``1 - count / max count`` of each whole label sequence."""
    counts = df.groupBy(seq).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("_top"))
    return (
        counts.crossJoin(F.broadcast(top))
        .withColumn("weight", 1 - F.col("n") / F.col("_top"))
        .drop("_top")
    )


def weigh_sequences(df: DataFrame, weights: DataFrame, seq: str) -> DataFrame:
    """Attach sequence weights; sequences not in the table weigh 1."""
    return df.join(weights.select(seq, "weight"), seq, "left").withColumn(
        "weight", F.coalesce("weight", F.lit(1.0))
    )


def weighted_mean(total: Column, n: Column) -> Column:
    """Total over count, zero where nothing was counted."""
    return F.coalesce(F.when(n != 0, total / n), F.lit(0.0))


def frame_budget(
    seqs: DataFrame,
    keys: Sequence[str],
    step: int,
    slots: int,
    variations: int,
    train_share: float = 0.8,
) -> DataFrame:
    """Samples a set of sequences will give, and how many go to training."""
    n = F.sum(F.floor((F.col("e") - F.col("b")) / step) + 1) * slots * variations
    return seqs.groupBy(*keys).agg(n.alias("n_samples")).withColumn(
        "n_train", F.floor(F.col("n_samples") * train_share)
    ).withColumn("n_val", F.col("n_samples") - F.col("n_train"))


def first_last(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"))


def earliest_latest(iv: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """Begin of the first and end of the last interval of one status."""
    return (
        iv.filter(F.col("status") == status)
        .groupBy(*keys)
        .agg(
            F.min("b").alias("earliest"),
            F.max_by("e", F.struct("b", "e")).alias("latest"),
        )
    )


def pivot_wide(
    df: DataFrame, keys: Sequence[str], category: str, value: str, categories: Sequence
) -> DataFrame:
    """One column per category, missing ones zero."""
    return (
        df.groupBy(*keys).pivot(category, list(categories)).agg(F.sum(value)).fillna(0)
    )


def nest_rounds(
    rounds: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    out: str,
    layout: Layout | None = None,
    part_rows: int = 100_000,
) -> DataFrame:
    """Rounds into one document row per key, an ordered array of structs.

    Every key has documents of ``part_rows`` consecutive rounds, numbered by ``part``
    from 0; where a round belongs depends on its place in the key alone.
    """
    from spanline.operators.intervals import chunk_sequences

    item = F.struct(*order, *[f for f in fields if f not in order])
    return (
        chunk_sequences(rounds, keys, order, part_rows, layout)
        .withColumn("part", F.col("chunk"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(item)).alias(out))
    )


def ordered_arrays(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    layout: Layout | None = None,
    part_rows: int = 100_000,
) -> DataFrame:
    """Arrays of values per key, in order: a label sequence.

    A sequence of more than ``part_rows`` values goes on in further rows, numbered by
    ``part`` from 0.
    """
    from spanline.operators.intervals import chunk_sequences

    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return (
        chunk_sequences(df.select(*dict.fromkeys([*keys, *order, value])), keys, order, part_rows, layout)
        .withColumn("part", F.col("chunk"))
        .groupBy(*keys, "part")
        .agg(F.transform(items, lambda x: x["_v"]).alias(out))
    )


def distinct_domain(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All distinct values over several columns, as ``value``."""
    return df.select(
        F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("value")
    ).filter(F.col("value").isNotNull()).distinct()


def char_domain(df: DataFrame, col: str) -> DataFrame:
    """Distinct characters used in a column, as ``value``."""
    return (
        df.select(col)
        .distinct()
        .select(F.explode(F.array_distinct(F.split(F.col(col), ""))).alias("value"))
        .filter(F.col("value") != "")
        .distinct()
    )


def transition_counts(
    iv: DataFrame,
    keys: Sequence[str],
    vocab: DataFrame,
    label: str = "status",
    init_prior: float = 1.0,
    pair_prior: float = 5.0,
    duration_unit: int = 1_000_000,
    layout: Layout | None = None,
) -> DataFrame:
    """Smoothed transition and initial probabilities of a label timeline.

    Every pair starts at ``pair_prior``; each change of state adds one to its pair,
    each interval its duration (in ``duration_unit``) to staying; rows are
    normalised.  ``init`` is the smoothed share of groups that start in ``cur``.
    """
    from spanline.operators.joins import dense_pairs

    layout = layout or Layout.inspect(iv, keys)
    nxt = scan(iv, keys, ["b", "e"], {"nxt": Next(label), "_rn": RunSum(F.lit(1))}, layout)
    seen = nxt.select(
        F.col(label).alias("cur"),
        F.explode(
            F.array(
                F.struct(F.col("nxt"), F.lit(1.0).alias("x"), F.lit(0.0).alias("i")),
                F.struct(
                    F.col(label).alias("nxt"),
                    ((F.col("e") - F.col("b")) / duration_unit).alias("x"),
                    (F.col("_rn") == 1).cast("double").alias("i"),
                ),
            )
        ).alias("_p"),
    ).select("cur", "_p.nxt", "_p.x", "_p.i").filter(F.col("nxt").isNotNull())
    counted = seen.groupBy("cur", "nxt").agg(F.sum("x").alias("x"), F.sum("i").alias("i"))
    dense = dense_pairs(vocab, label).join(counted, ["cur", "nxt"], "left")
    dense = dense.select(
        "cur",
        "nxt",
        (F.coalesce("x", F.lit(0.0)) + pair_prior).alias("weight"),
        F.coalesce("i", F.lit(0.0)).alias("i"),
    )
    row = Window.partitionBy("cur")
    dense = dense.withColumn("p", F.col("weight") / F.sum("weight").over(row)).withColumn(
        "_init", F.sum("i").over(row) + init_prior
    )
    starts = dense.select("cur", "_init").distinct().agg(F.sum("_init").alias("_all"))
    return (
        dense.crossJoin(F.broadcast(starts))
        .select(
            "cur", "nxt", "weight", "p", (F.col("_init") / F.col("_all")).alias("init")
        )
    )


def dedup_by_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """First row per key by ``order``; an aggregate, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, "_r.*").select(*df.columns)
