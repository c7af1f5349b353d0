"""The second pass over recordings against plain statements of its rules."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from spanline.plans import refine

STEP, FINE = 10, 1
LABELS = ["game", "not_game", "pause", "replay", "pause_split screen"]


def _case(seed):
    """Recordings with rounds and parts on the coarse grid and samples at every fine step."""
    rnd = random.Random(seed)
    fine, rounds, parts = [], [], []
    for k in (1, 2, 3, None):
        state = rnd.choice(LABELS)
        for t in range(-3, 400):
            if rnd.random() < 0.15:
                state = rnd.choice(LABELS)
            fine.append((k, t, state))
        for r in range(1, 4):
            b = (r - 1) * 130 + rnd.randrange(3) * STEP
            e = b + rnd.randrange(5, 11) * STEP
            rounds.append((k, r, b, e, f"map{r}"))
            for kind, typ in [("pause", "Out of game pause"), ("pause", "Split screen"),
                              ("pause", "Ingame pause"), ("replay", None)]:
                x = rnd.randrange(3) * STEP
                parts.append((k, r, kind, typ, x, x + rnd.randrange(1, 3) * STEP))
    return fine, rounds, parts


def _bound(fine, key, label, b, e):
    times = [t for k, t, s in fine if k == key and s == label and t >= 0]
    first = [t for t in times if b - STEP <= t <= b]
    last = [t for t in times if e - STEP <= t <= e + STEP]
    return (min(first) if first else b), (max(last) + FINE if last else e)


def _label(kind, typ):
    return {"Out of game pause": "not_game", "Split screen": "pause_split screen"}.get(typ, kind)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds(spark, seed):
    fine, rounds, parts = _case(seed)
    r = spark.createDataFrame(rounds, "vod int, round int, b bigint, e bigint, map string")
    p = spark.createDataFrame(parts, "vod int, round int, kind string, type string, b bigint, e bigint")
    f = spark.createDataFrame(fine, "vod int, t bigint, label string")
    got, moved = refine.refine_rounds(
        r.filter("vod is not null"), p.filter("vod is not null"), f, "vod", STEP, FINE
    )
    want, want_parts, starts = [], [], {}
    for k, n, b, e, m in rounds:
        if k is not None:
            x, y = _bound(fine, k, "game", b, e)
            starts[k, n] = (b, x)
            want.append((k, n, x, y, m))
    for k, n, kind, typ, b, e in parts:
        if k is not None:
            old, new = starts[k, n]
            x, y = _bound(fine, k, _label(kind, typ), b + old, e + old)
            want_parts.append((k, n, kind, typ, x - new, y - new))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert Counter(map(tuple, moved.collect())) == Counter(want_parts)
    assert any(a[2:4] != b[2:4] for a, b in zip(want, [x for x in rounds if x[0] is not None]))


def test_only_folders_near_a_bound_are_read(spark, tmp_path):
    path = str(tmp_path / "fine")
    fine = spark.range(4_000).selectExpr(
        "cast(id % 4 as int) as vod", "id div 4 as t", "'game' as label"
    )
    refine.write_fine(fine, path, "vod", 50)
    bounds = spark.createDataFrame([(1, 100, 300), (2, 990, 995)], "vod int, b bigint, e bigint")
    near = refine.read_near(spark, path, bounds, "vod", 50, 10)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    rows = {(r.vod, r.t) for r in near.collect()}
    wanted = {(1, t) for c in (100, 300) for t in range(c - 10, c + 11)}
    wanted |= {(2, t) for t in range(980, 1000)}
    assert wanted <= rows and len(rows) < 4_000 / 4
    empty = refine.read_near(spark, path, bounds.limit(0), "vod", 50, 10)
    assert empty.count() == 0


def test_names(spark):
    teams = [(1, 1, n) for n in ("anna", "bert", "carl")] + [(1, 2, n) for n in ("xena", "yuri", "zora")]
    rounds = [(1, 1, 0, 100), (1, 2, 200, 300)]
    parts = [(1, 1, "replay", None, 2, 10)]  # names of round 1 from 11 on
    seen = [
        # round 1: ahead of the window, then read; team 2 is on the left
        (1, "left", 1, 3, "anna"), (1, "left", 1, 11, "xen"), (1, "left", 1, 12, "xen"),
        (1, "left", 1, 13, "xena"), (1, "left", 2, 12, "yuri"), (1, "left", 3, 12, "zo"),
        (1, "right", 1, 12, "bart"), (1, "right", 2, 12, "an"), (1, "right", 3, 12, "carl"),
        (1, "right", 3, 16, "anna"),  # behind the window
        # round 2: team 1 on the left, one name read wrongly
        (1, "left", 1, 200, "anna"), (1, "left", 2, 201, "carl"), (1, "left", 3, 201, "dert"),
        (1, "right", 1, 203, "xena"),
        (2, "left", 1, 3, "nobody"),  # no round
    ]
    got = refine.players_of_rounds(
        spark.createDataFrame(seen, "vod int, side string, slot int, t bigint, name string"),
        spark.createDataFrame(rounds, "vod int, round int, b bigint, e bigint"),
        spark.createDataFrame(parts, "vod int, round int, kind string, type string, b bigint, e bigint"),
        spark.createDataFrame(teams, "vod int, team int, name string"),
        "vod", 5, 1, 5,
    )
    rows = {(r.round, r.side, r.slot): (r.team, r["name"], r.player) for r in got.collect()}
    assert rows == {
        (1, "left", 1): (2, "xena", "xena"), (1, "left", 2): (2, "yuri", "yuri"), (1, "left", 3): (2, "zo", "zora"),
        (1, "right", 1): (1, "bart", "bert"), (1, "right", 2): (1, "an", "anna"), (1, "right", 3): (1, "carl", "carl"),
        (2, "left", 1): (1, "anna", "anna"), (2, "left", 2): (1, "carl", "carl"), (2, "left", 3): (1, "dert", "bert"),
        (2, "right", 1): (2, "xena", "xena"),
    }
