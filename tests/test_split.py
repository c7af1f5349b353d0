"""The split plan of every scan gives what the plain one gives, with one hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanline import ordered
from spanline.operators import derive, events, features, intervals, joins, segment, tables, votes
from spanline.ordered import Layout
from spanline.session import MAX_GROUP_ROWS

K = ["g"]


def table(spark, n=400, seed=3, steps=(1, 1, 2, 7)):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice(steps)
        g = 1 if rnd.random() < 0.6 else rnd.choice([2, 3, None])
        rows.append((g, i, t, rnd.choice("abc"), rnd.choice([None, 1, 2, 5]), rnd.random() < 0.3))
    return spark.createDataFrame(
        rows, "g int, i int, t bigint, label string, v int, flag boolean"
    ).repartition(3)


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def both(spark, make):
    plain = rows(make())
    spark.conf.set(MAX_GROUP_ROWS, "40")
    try:
        split = rows(make())
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    assert plain
    assert split == plain


STEPS = {
    "prev": lambda: ordered.Prev("v"),
    "next": lambda: ordered.Next("v"),
    "total": lambda: ordered.RunSum("v"),
    "top": lambda: ordered.RunMax("v"),
    "before": lambda: ordered.MaxBefore("v"),
    "last": lambda: ordered.LastValue("v"),
    "following": lambda: ordered.NextValue("v"),
    "tail": lambda: ordered.LastN("i", 4),
}


def test_layout_sees_the_hot_key(spark):
    df = table(spark)
    assert not Layout.inspect(df, K).split
    spark.conf.set(MAX_GROUP_ROWS, "50")
    try:
        layout = Layout.inspect(df, K)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    assert layout.split and layout.pieces >= 16


def test_all_steps(spark):
    df = table(spark, steps=(0, 0, 1))
    both(spark, lambda: ordered.scan(df, K, ["t", "i"], {n: s() for n, s in STEPS.items()}))


def test_no_keys(spark):
    df = table(spark)
    both(spark, lambda: ordered.scan(df, [], ["t", "i"], {n: s() for n, s in STEPS.items()}))


def states(spark):
    return intervals.run_length_encode(table(spark), K, "t", "label", ["i"]).drop("n")


OPS = {
    "rle": lambda s: intervals.run_length_encode(table(s), K, "t", "label", ["i"]),
    "min_duration": lambda s: intervals.filter_min_duration(states(s), K, {"a": 3, "b": 5}, True),
    "anchor": lambda s: intervals.anchor_smooth(states(s), K, 2, "c"),
    "sandwich": lambda s: intervals.sandwich_relabel(
        states(s), K, [("a", "b", "c", "c")], "a", [("b", "a")]
    ),
    "snap": lambda s: intervals.snap_begin(states(s), K, 5, 1),
    "union": lambda s: intervals.union_intervals(
        table(s).select("g", F.col("t").alias("b"), (F.col("t") + 3).alias("e")), K
    ),
    "ranges": lambda s: intervals.event_ranges(table(s).filter("flag"), K, "t", 4),
    "chunks": lambda s: intervals.chunk_sequences(table(s), K, ["t", "i"], 7),
    "state_at": lambda s: joins.state_at(table(s).select("g", "i", (F.col("t") + 1).alias("t")), states(s), K),
    "asof": lambda s: joins.asof_forward(table(s).select("g", "i", "t"), states(s), K),
    "not_within": lambda s: joins.not_within(
        states(s), states(s).select("g", "b", (F.col("e") + 6).alias("e")).filter("b % 3 = 0"), K
    ),
    "nearest": lambda s: joins.nearest_event(
        table(s).filter("flag").select("g", "i", "t"), table(s).filter("not flag").select("g", "t", F.col("i").alias("j")),
        K, "t", 9, "j",
    ),
    "pending": lambda s: joins.lookahead_pending(
        table(s).filter("flag").select("g", "i", "t"), table(s).select("g", "t", F.col("i").alias("event_id")), K, "t", 3, 9
    ),
    "feed": lambda s: events.feed_at(
        table(s).filter("flag").select("g", "i", "t"), table(s).select("g", "t", F.col("i").alias("event_id")), K, "t", 9, 3
    ),
    "dedup": lambda s: events.dedup_observations(table(s), K, ["label"], "t", 3),
    "games": lambda s: segment.segment_games(table(s), K, ["t", "i"], "label"),
    "fill": lambda s: segment.forward_fill(table(s), K, ["t", "i"], ["v"]),
    "rounds": lambda s: segment.segment_rounds(states(s), K, 2, "a", "b", "c", "r", "s", "x")[0],
    "parts": lambda s: segment.segment_rounds(states(s), K, 2, "a", "b", "c", "r", "s", "x")[1],
    "rising": lambda s: derive.rising_only(table(s), K, ["t", "i"], "v"),
    "lifecycle": lambda s: derive.lifecycle(states(s), K, ("a", "b", "c"), max_gap=3, tick=1, long_after=4),
    "top": lambda s: tables.top_newest(table(s), K, "t", 4, "i"),
    "first": lambda s: tables.first_n(table(s), K, ["t", "i"], 4),
    "split": lambda s: features.split_train_val(table(s).filter("g is not null"), K, "i", 0.8, 1),
    "transitions": lambda s: votes.transition_counts(
        states(s), K, s.createDataFrame([("a",), ("b",), ("c",)], "status string"), duration_unit=1
    ).select("cur", "nxt", F.round("p", 9).alias("p"), F.round("init", 9).alias("init")),
    "grid": lambda s: intervals.sampling_grid(
        states(s), K, s.createDataFrame([("a", 2), ("b", 1)], "status string, step_us bigint"), 3
    ),
}


@pytest.mark.parametrize("name", OPS)
def test_operator(spark, name):
    both(spark, lambda: OPS[name](spark))


def test_checkpoint_folder_is_the_named_one(spark):
    from spanline.session import cut_lineage

    named = spark.conf.get("spark.checkpoint.dir", None)
    cut_lineage(spark.range(3).toDF("x"))
    where = spark.sparkContext.getCheckpointDir()
    assert where
    if named:
        assert named.rstrip("/") in where
