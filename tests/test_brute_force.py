"""Order-dependent operators against sequential statements of their rules."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spanline.operators import derive, events, features, joins, segment
from spanline.ordered import Layout

K = ["g"]
EVENT = "g int, first_hero string, first_side string, second_hero string, second_side string, b bigint, duration bigint, ord bigint"


def observations(seed, n=60):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 1, 2, 3, 15])
        rows.append(
            (1, rnd.choice(["h1", "h2", None]), rnd.choice(["left", "right"]), rnd.choice(["v1", "npc"]),
             rnd.choice(["left", "right"]), t, rnd.choice([0, 0, 1, 2, 4, 9]), i)
        )
    rows.sort(key=lambda r: (r[5], r[6], r[7]))
    return rows


def close(a, b):
    if a[3:5] != b[3:5]:
        return False
    if a[3] == "npc":
        return a[1] == b[1] or a[1] is None or b[1] is None
    return a[1:3] == b[1:3]


def merged(rows, gap, cap):
    kept = []
    for p in rows:
        for j, q in enumerate(kept):
            stop = q[5] + q[6]
            if close(p, q) and abs(stop - p[5]) <= gap and q[6] + p[6] < cap:
                long, short = (p, q) if p[6] > q[6] else (q, p)
                hero = short[1] if long[1] is None and long[2] in ("left", "right") else long[1]
                kept[j] = (1, hero, long[2], q[3], q[4], q[5], q[6] + p[6], q[7])
                break
            if close(p, q) and stop > p[5] > q[5]:
                break
        else:
            kept.append(p)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_merge_similar(spark, seed):
    rows = observations(seed)
    df = spark.createDataFrame(rows, EVENT)
    got = [tuple(r) for r in events.merge_similar(df, K, ["npc"], 3, 8).select(*[c.split()[0] for c in EVENT.split(", ")]).collect()]
    assert sorted(got, key=repr) == sorted(merged(rows, 3, 8), key=repr)


def merged_npc(rows, span, cap, target, least):
    kept, seen = [], set()
    for p in rows:
        for q in kept:
            if q["d"] < target or not close(p, q["row"]):
                continue
            if p[5] + p[6] < q["row"][5] + span and q["d"] < cap:
                q["d"] = p[5] + p[6] - q["row"][5]
                break
        else:
            key = (p[5], p[3], p[4])
            if key not in seen:
                kept.append({"row": p, "d": p[6]})
                seen.add(key)
    return [(q["row"][5], q["row"][4], q["d"]) for q in kept if q["d"] > least]


@pytest.mark.parametrize("seed", range(4))
def test_merge_npc(spark, seed):
    rows = sorted((r for r in observations(seed, 90) if r[3] == "npc"), key=lambda r: (r[5], r[7]))
    df = spark.createDataFrame(rows, EVENT)
    got = [(r.b, r.second_side, r.duration) for r in events.merge_npc(df, K, ["npc"], 7, 8, 1, 2).collect()]
    assert sorted(got) == sorted(merged_npc(rows, 7, 8, 1, 2))


def stepped_rounds(rows, least):
    """Rounds and parts by walking the intervals one by one."""
    cur, rounds, paused = None, [], False
    for i, (s, b, e) in enumerate(rows):
        after = rows[i + 1][0] if i + 1 < len(rows) else None
        if cur is None:
            if s in ("game", "small", "split"):
                beg = rows[i - 1][2] if s != "game" and i and rows[i - 1][0] == "not_game" else b
                cur = {"b": beg, "e": e, "parts": []}
                if s == "small":
                    cur["parts"].append(["smaller_window", None, b - beg, e - beg])
                if s == "split":
                    cur["parts"].append(["pause", "Split screen", b - beg, e - beg])
            continue
        rb, re = b - cur["b"], e - cur["b"]
        pauses = [p for p in cur["parts"] if p[0] == "pause"]
        if s == "pause" and not paused:
            paused = True
            cur["parts"].append(["pause", "Ingame pause", rb, re])
        elif paused:
            if s == "game":
                pauses[-1][3] = rb
                paused = False
                cur["e"] = e
            elif s == "pause":
                pauses[-1][3] = rb
                cur["parts"].append(["pause", "Ingame pause", rb, re])
            elif pauses[-1][1] != "Out of game pause":
                pauses[-1][3] = rb
                cur["parts"].append(["pause", "Out of game pause", rb, re])
            else:
                pauses[-1][3] = re
        elif s == "not_game":
            rounds.append(cur)
            cur = None
        elif s == "game":
            cur["e"] = e
        elif after == "game" and s in ("replay", "small"):
            cur["parts"].append(["replay" if s == "replay" else "smaller_window", None, rb, re])
    if cur is not None:
        rounds.append(cur)
    return [r for r in rounds if r["e"] - r["b"] > least]


@pytest.mark.parametrize("seed", range(6))
def test_rounds(spark, seed):
    rnd = random.Random(seed)
    rows, t, last = [], 0, None
    for _ in range(80):
        s = rnd.choice([x for x in ("game", "not_game", "pause", "replay", "small", "split") if x != last])
        end = t + rnd.randint(0, 9)
        rows.append((s, t, end))
        t, last = end + 1, s
    df = spark.createDataFrame([(1, b, e, s) for s, b, e in rows], "g int, b bigint, e bigint, status string")
    rounds, parts = segment.segment_rounds(
        df, K, 5, "game", "not_game", "pause", "replay", "small", "split"
    )
    want = stepped_rounds(rows, 5)
    assert sorted((r.b, r.e) for r in rounds.collect()) == [(r["b"], r["e"]) for r in want]
    begins = {r.round: r.b for r in rounds.collect()}
    got = sorted(repr([begins[p.round], p.kind, p.type, p.b, p.e]) for p in parts.collect())
    assert got == sorted(repr([r["b"], *p]) for r in want for p in r["parts"])


def suppressed(ults, hero, alive, quick, before):
    def at(rows, t):
        return next((s for s, b, e in rows if b <= t <= e), None)

    kept = []
    for u in ults:
        if kept and at(hero, u["gained"]) == "s":
            last = kept[-1]
            if u["used"] is not None and u["used"] - u["gained"] < quick and at(alive, u["gained"] - before) != "alive":
                continue
            if last["ended"] is not None and u["gained"] - quick < last["ended"]:
                continue
            if last["used"] is None and u["used"] is not None and at(hero, last["gained"]) == "s" and at(hero, u["used"]):
                last.update(used=u["used"], ended=u["ended"])
                continue
        kept.append(dict(u))
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_suppression(spark, seed):
    rnd = random.Random(seed)

    def line(labels):
        rows, t = [], 0
        while t < 400:
            end = t + rnd.randint(3, 30)
            rows.append((rnd.choice(labels), t, end))
            t = end + rnd.choice([1, 1, 4])
        return rows

    hero, alive = line(["s", "s", "o"]), line(["alive", "dead"])
    ults, t = [], 0
    while t < 380:
        t += rnd.randint(1, 12)
        u = {"gained": t, "used": None, "ended": None}
        if rnd.random() < 0.6:
            u["used"] = t + rnd.randint(0, 4)
            u["ended"] = u["used"] + rnd.randint(0, 12)
        ults.append(u)
    ddl = "g int, b bigint, e bigint, status string"
    h = spark.createDataFrame([(1, b, e, s) for s, b, e in hero], ddl)
    a = spark.createDataFrame([(1, b, e, s) for s, b, e in alive], ddl)
    u = spark.createDataFrame([(1, x["gained"], x["used"], x["ended"]) for x in ults], "g int, gained bigint, used bigint, ended bigint")
    got = derive.suppress_repeats(u, h, a, K, "s", quick=3, dead_before=1).collect()
    want = suppressed(ults, hero, alive, 3, 1)
    assert sorted(((r.gained, r.used, r.ended) for r in got), key=repr) == sorted(
        ((w["gained"], w["used"], w["ended"]) for w in want), key=repr
    )


def best_path(scores, trans, init):
    best, back = init + scores[0], []
    for s in scores[1:]:
        cand = best[:, None] + trans
        back.append(cand.argmax(axis=0))
        best = cand.max(axis=0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("block, split", [(1, False), (3, False), (1000, False), (1, True), (2, True)])
def test_viterbi(spark, block, split):
    rng = np.random.default_rng(5)
    trans = np.log(rng.dirichlet(np.ones(3), 3))
    init = np.log(rng.dirichlet(np.ones(3)))
    data, want = [], {}
    for g, n in ((1, 20), (2, 1), (3, 7)):
        s = np.log(rng.dirichlet(np.ones(3), n))
        data += [(g, i, [float(x) for x in s[i]]) for i in range(n)]
        want.update({(g, i): p for i, p in enumerate(best_path(s, trans, init))})
    df = spark.createDataFrame(data, "g int, t bigint, scores array<double>")
    layout = Layout(split, 4)
    got = features.viterbi_smooth(
        df, trans, init, K, block=block, fan=4, layout=layout
    ).collect()
    assert {(r.g, r.t): r.state for r in got} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_assign(spark):
    rnd = random.Random(9)
    roster = ["alpha", "bravo", "carol", "delta"]
    names = ["alpha", "brvo", "crl", "delt", "echo", "alpa"]
    rows = []
    for g in range(6):
        rnd.shuffle(names)
        rows += [(g, i, n) for i, n in enumerate(names)]
    want = {}
    for g in range(6):
        mine = [r for r in rows if r[0] == g]
        free = sorted(set(roster) - {n for _, _, n in mine})
        for _, i, n in mine:
            if n in roster:
                want[g, i] = n
                continue
            pick = min(free, key=lambda r: (distance(n, r), r), default=None)
            if pick is not None:
                free.remove(pick)
            want[g, i] = pick or n
    df = spark.createDataFrame(rows, "g int, slot int, name string")
    r = spark.createDataFrame([(g, n) for g in range(6) for n in roster], "g int, name string")
    got = joins.fuzzy_assign(df, r, K).collect()
    assert {(x.g, x.slot): x.assigned for x in got} == want
