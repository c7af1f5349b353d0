"""Look-ups and statistics without limits on vocabularies, rosters or sums."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanline.operators import features, joins, votes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_nearest_name_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    roster = sorted({word(rng.randrange(0, 9)) for _ in range(150)} | {"x" * 250})
    names = [rng.choice(roster) + rng.choice(["", "a", "zz"]) for _ in range(60)] + [word(12) for _ in range(20)]
    names += ["", "zzzzzzzz", None, "y" * 300, "x" * 249, *names[:10]]
    left = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id int, name string")
    right = spark.createDataFrame([(n,) for n in [*roster, roster[3], None]], "r string")
    got = joins.nearest_name(left, right, "name", "r", block=16)
    want = []
    for k, n in enumerate(names):
        if n is not None:
            d, best = min((distance(n, r), r) for r in roster)
            want.append((k, n, best, d))
    assert got.columns == ["id", "name", "best_name", "best_distance"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert joins.nearest_name(left, right.limit(0), "name", "r").count() == 0


def test_nearest_name_in_a_large_roster(spark):
    """200,000 names."""
    roster = spark.range(200_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 7).alias("r"))
    some = [r["r"] for r in roster.limit(4000).collect()][::40]
    names = spark.createDataFrame([(s[:3] + "-" + s[4:],) for s in some], "name string")
    got = joins.nearest_name(names, roster, "name", "r").collect()
    assert len(got) == len(some) and all(r["best_distance"] == 1 for r in got)


def test_large_vocabularies(spark):
    labels = spark.range(30_000).select(F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("label"))
    out = features.label_index(labels.union(labels), "label", labels.repartition(7))
    assert out.columns == ["label", "label_id"] and out.count() == 60_000
    assert out.filter(F.col("label_id") != F.substring("label", 2, 6).cast("int")).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        features.label_index(labels, "label", labels.limit(10)).collect()
    few = labels.limit(70)
    assert joins.dense_pairs(few, "label").distinct().count() == 4900


def test_median_of_a_million_sums(spark):
    """Upper median, with equal and negative numbers, and no rows."""
    iv = spark.range(1_000_000).select(
        F.col("id").alias("status"), F.lit(0).cast("bigint").alias("b"), (F.xxhash64("id") % 1_000_003).alias("e")
    )
    durs = sorted(r["e"] for r in iv.select("e").collect())
    assert votes.play_time(iv).select("median").first()[0] == durs[500_000]
    for values in ([5], [1, 2], [3, 3, 3, 9], [-7, 2**62, 0], list(range(-5, 4))):
        df = spark.createDataFrame([(v,) for v in values], "x bigint")
        assert [votes.order_statistic(df, "x", k, bits=3) for k in range(len(values))] == sorted(values)
    assert votes.play_time(iv.filter("status < 0")).count() == 0


def test_relaxed_match_with_nulls_and_a_hot_prefix(spark):
    rng = random.Random(2)
    pick = lambda n: rng.choice([None, *range(n)])
    left = [(k, rng.choice([0, 0, 0, 1, None]), pick(4), pick(9), bool(k % 2)) for k in range(400)]
    right = [(k, rng.choice([0, 0, 0, 1, None]), pick(4), pick(9), bool(k % 3)) for k in range(60)]
    schema = "id int, a int, b int, c int, flag boolean"
    r = spark.createDataFrame(right, schema).withColumnRenamed("id", "ord")
    got = joins.relaxed_match(spark.createDataFrame(left, schema).repartition(3), r, ["a", "b", "c"], [3, 2, 1], "id", "ord", "flag")
    want = []
    for k, *fields, flag in left:
        hit = (None, None)
        for n in (3, 2, 1):
            same = [o for o, *other, f in right if other[:n] == fields[:n] and f == flag]
            if same:
                hit = (min(same), n)
                break
        want.append((k, *fields, flag, *hit))
    assert got.columns == ["id", "a", "b", "c", "flag", "matched_ord", "matched_fields"]
    assert sorted(str(tuple(x)) for x in got.collect()) == sorted(map(str, want))


def test_scores_of_null_vectors(spark):
    import numpy as np

    rows = [(1, "m", [1.0, 2.0]), (2, "m", None), (3, "n", [3.0, 0.0]), (4, "n", [None, 1.0]), (5, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, mode string, v array<double>").coalesce(1)
    got = features.score_batches(df, {"base": np.array([[1, 0], [0, 1]]), "n": np.array([[0, 1], [1, 0]])}, "mode", "id", "v")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 2.0), (2, None, None), (3, 1, 3.0), (4, None, None), (5, 1, 1.0)]
