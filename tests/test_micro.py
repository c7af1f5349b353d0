"""Hand-written fixtures of the core semantics (times in ticks)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanline.functions.arrays import ctc_collapse
from spanline.operators import derive, events, intervals, joins, segment, votes

K = ["g"]


def frame(spark, rows):
    return spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(rows)], "g int, ord int, t bigint, label string")


def iv(spark, rows):
    return spark.createDataFrame([(1, b, e, s) for s, b, e in rows], "g int, b bigint, e bigint, status string")


def out(df):
    return sorted((r.status, r.b, r.e) for r in df.collect())


def by_time(rows):
    return sorted(rows, key=lambda r: (r[1], r[2], r[0]))


def test_rle(spark):
    df = intervals.run_length_encode(frame(spark, [(0, "a"), (1, "a"), (2, "b"), (3, "a")]), K)
    assert by_time(out(df)) == [("a", 0, 1), ("b", 2, 2), ("a", 3, 3)]


@pytest.mark.parametrize(
    "rows, thr, protect, expected",
    [
        ([("a", 0, 9), ("b", 10, 10), ("a", 11, 20)], 2, False, [("a", 0, 20)]),
        ([("a", 0, 9), ("b", 10, 10), ("c", 11, 20)], 2, False, [("a", 0, 9), ("c", 11, 20)]),
        ([("a", 0, 9), ("b", 10, 10)], 2, False, [("a", 0, 9), ("b", 10, 10)]),
        ([("b", 0, 0), ("a", 1, 9)], 2, True, [("b", 0, 0), ("a", 1, 9)]),
        ([("a", 0, 9), ("b", 10, 15), ("a", 16, 30)], 5, False, [("a", 0, 9), ("b", 10, 15), ("a", 16, 30)]),
    ],
)
def test_min_duration(spark, rows, thr, protect, expected):
    df = intervals.filter_min_duration(iv(spark, rows), K, thr, protect)
    assert by_time(out(df)) == expected


def test_min_duration_from_origin(spark):
    df = intervals.filter_min_duration(iv(spark, [("b", 0, 0), ("a", 1, 9)]), K, 2, origin=0)
    assert out(df) == [("a", 0, 9)]


def test_anchor_is_strict(spark):
    df = intervals.anchor_smooth(iv(spark, [("a", 0, 9), ("b", 10, 15), ("a", 16, 30)]), K, 5)
    assert out(df) == [("a", 0, 30)]


@pytest.mark.parametrize("t, closed, after", [(5, "x", "y"), (12, None, "y"), (0, "x", "x"), (6, "y", "y")])
def test_point_lookups(spark, t, closed, after):
    states = iv(spark, [("x", 0, 5), ("y", 6, 9)])
    p = spark.createDataFrame([(1, t)], "g int, t bigint")
    assert joins.state_at(p, states, K).first()["status"] == closed
    assert joins.asof_forward(p, states, K).first()["status"] == after


def test_touching_intervals_give_the_first(spark):
    states = iv(spark, [("x", 0, 5), ("y", 5, 9)])
    p = spark.createDataFrame([(1, 5)], "g int, t bigint")
    assert joins.state_at(p, states, K).first()["status"] == "x"
    assert joins.state_at(p, states, K, closed="left").first()["status"] == "y"


def test_nearest_tie_is_earliest_and_cap_inclusive(spark):
    d = spark.createDataFrame([(1, 100)], "g int, t bigint")
    feed = spark.createDataFrame([(1, 30, 7), (1, 170, 8)], "g int, t bigint, id int")
    assert joins.nearest_event(d, feed, K, "t", 70).first()["match"]["id"] == 7
    far = spark.createDataFrame([(1, 29, 7)], "g int, t bigint, id int")
    r = joins.nearest_or_default(d, far, K, "t", 70, {"id": "n/a"}).first()
    assert (r["id"], r["matched"], r["event_t"]) == ("n/a", False, 100)


def test_dedup_gap_inclusive(spark):
    df = spark.createDataFrame([(1, "x", t) for t in (0, 5, 11)], "g int, ev string, t bigint")
    rows = events.dedup_observations(df, K, ["ev"], "t", 5).collect()
    assert sorted((r.b, r.duration) for r in rows) == [(0, 5), (11, 0)]


def test_ctc(spark):
    df = spark.createDataFrame([([0, 3, 3, 0, 3, 4],), ([3, 3],), ([],)], "a array<int>")
    got = [r[0] for r in df.select(ctc_collapse("a")).collect()]
    assert got == [[3, 3, 4], [3], []]


def test_event_ranges(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 50, 200)], "g int, t bigint")
    rows = intervals.event_ranges(df, K, "t", 80, 240).collect()
    assert sorted((r.b, r.e) for r in rows) == [(0, 130), (200, 240)]


def test_version_bounds_half_open(spark):
    v = segment.version_intervals(
        spark.createDataFrame([(dt.date(2018, 1, 1),), (dt.date(2018, 2, 1),)], "begin date"), "begin", "2018-03-01"
    ).withColumn("version", F.date_format("begin", "MM"))
    d = spark.createDataFrame([(dt.date(2018, 2, 1),), (dt.date(2017, 1, 1),)], "d date")
    got = {r.d.year: (r.version, r.progress) for r in joins.valid_at(d, v, "d").collect()}
    assert got == {2018: ("02", 0.0), 2017: (None, None)}


def test_transitions(spark):
    states = iv(spark, [("a", 0, 10), ("b", 11, 21), ("a", 22, 32)])
    rows = votes.transition_counts(states, K, states, duration_unit=1).collect()
    total = {}
    for r in rows:
        total[r.cur] = total.get(r.cur, 0) + r.p
    assert {k: round(v, 9) for k, v in total.items()} == {"a": 1.0, "b": 1.0}
    assert {(r.cur, r.nxt): r.weight for r in rows} == {
        ("a", "a"): 25.0, ("a", "b"): 6.0, ("b", "a"): 6.0, ("b", "b"): 15.0,
    }


@pytest.mark.parametrize("last_dead, n", [(98, 1), (99, 0)])
def test_revive_limit(spark, last_dead, n):
    states = iv(spark, [("dead", 0, last_dead), ("alive", last_dead + 1, 200)])
    assert derive.revives(states, K, 98).count() == n


def test_rising(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 1, 2, 1, 3])], "g int, i int, v int")
    assert sorted(r.v for r in derive.rising_only(df, K, ["i"], "v").collect()) == [1, 2, 3]


def test_games(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate("mmnm")], "g int, i int, map string")
    rows = sorted(segment.segment_games(df, K, ["i"], "map").collect(), key=lambda r: r.i)
    assert [r.game_number for r in rows] == [1, 1, 2, 3]
    assert [r.round_number for r in rows] == [1, 2, 1, 1]
