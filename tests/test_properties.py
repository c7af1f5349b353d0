"""Properties on random timelines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanline.operators import features, intervals

K = ["g"]


def samples(spark, seed):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(150):
        t += rnd.randint(1, 4)
        rows.append((rnd.randint(1, 3), i, t, rnd.choice("abc")))
    return spark.createDataFrame(rows, "g int, i int, t bigint, label string")


def plain(df):
    return sorted(map(tuple, df.select("g", "b", "e", "status").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_laws(spark, seed):
    s = samples(spark, seed)
    iv = intervals.run_length_encode(s, K)
    assert iv.agg(F.sum("n")).first()[0] == 150
    once = intervals.coalesce_intervals(iv, K)
    assert plain(intervals.coalesce_intervals(once, K)) == plain(once) == plain(iv)
    assert plain(intervals.filter_min_duration(iv, K, 0)) == plain(once)


def test_union_is_disjoint_and_keeps_the_measure(spark):
    s = samples(spark, 3).select("g", F.col("t").alias("b"), (F.col("t") + 1 + F.col("i") % 9).alias("e"))
    got = intervals.union_intervals(s, K).collect()
    by_group: dict[int, set] = {}
    for r in s.collect():
        by_group.setdefault(r.g, set()).update(range(r.b, r.e))
    for g, covered in by_group.items():
        mine = sorted((r.b, r.e) for r in got if r.g == g)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
        assert sum(e - b for b, e in mine) == len(covered)


def test_split_share_is_exact(spark):
    s = samples(spark, 4)
    got = features.split_train_val(s, K, "i", 0.8, 5).groupBy("g").pivot("split", ["train", "val"]).count().collect()
    for r in got:
        assert r.train == int((r.train + r.val) * 0.8)


def test_grid_of_a_long_interval_is_whole(spark):
    iv = spark.createDataFrame([(1, 0, 25_000)], "g int, b bigint, e bigint")
    grid = intervals.uniform_grid(iv, K, 1, 0)
    assert grid.agg(F.count("t"), F.max("t"), F.count_distinct("tick")).first()[:] == (25_001, 25_000, 25_001)
