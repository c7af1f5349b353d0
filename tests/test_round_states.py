"""Effects of players: causes among enemies, friends and the victim, and a living victim."""

from __future__ import annotations

from spanline.operators.derive import effects
from spanline.plans.annotate import PlayerRules, player_effects, round_properties

SECOND = 1_000_000
IV = "round bigint, side string, slot bigint, b bigint, e bigint, status string"
CAUSES = "effect string, relation string, cause string, lead_us bigint"


def test_own_state_and_living_victim(spark):
    heroes = spark.createDataFrame(
        [
            (1, "left", 1, 0, 100, "tank"), (1, "left", 2, 0, 100, "other"),
            (1, "right", 1, 0, 100, "plain"), (2, "left", 1, 0, 100, "other"),
            (2, "right", 1, 0, 100, "stunner"),
        ],
        IV,
    )
    seen = spark.createDataFrame(
        [
            (1, "left", 1, 10, 20, "stunned"),  # the victim's own hero
            (1, "left", 2, 10, 20, "stunned"),  # a friend's hero is no reason
            (2, "left", 1, 10, 20, "stunned"),  # an enemy's is
            (1, "right", 1, 30, 40, "asleep"),  # lived at 25
            (1, "right", 1, 60, 70, "asleep"),  # dead at 55
            (2, "right", 1, 60, 70, "hurt"),  # no rule
        ],
        IV,
    )
    rules = spark.createDataFrame(
        [("stunned", "enemy", "stunner", 0), ("stunned", "own", "tank", 0)], CAUSES
    )
    alive = spark.createDataFrame([(1, "right", 1, 0, 50, "alive")], IV)
    lived = spark.createDataFrame([("asleep", 5)], "effect string, lead_us bigint")
    got = effects(seen, heroes, rules, ["round"], {}, 1, "normal", None, alive, lived)
    assert sorted((r.round, r.side, r.slot, r.e, r.status) for r in got.collect()) == [
        (1, "left", 1, 21, "stunned"), (1, "right", 1, 41, "asleep"), (2, "left", 1, 21, "stunned"),
        (2, "right", 1, 71, "hurt"),
    ]


def test_player_effects(spark):
    """From labels to effects: an enemy's hero, a death in between, a length that is cut."""
    tick = SECOND // 10
    rows = []
    for n in range(200):
        t = n * tick
        dead = 60 <= n < 100
        status = "antiheal" if 20 <= n < 30 or 120 <= n < 180 else "asleep" if 80 <= n < 90 else "normal"
        rows += [
            (1, "left", 1, t, "hero", "a"), (1, "left", 1, t, "alive", "dead" if dead else "alive"),
            (1, "left", 1, t, "status", status), (1, "right", 1, t, "hero", "ana"),
            (1, "right", 1, t, "alive", "alive"), (1, "right", 1, t, "status", status),
        ]
    labels = spark.createDataFrame(
        rows, "round bigint, side string, slot bigint, t bigint, attr string, label string"
    )
    causes = spark.createDataFrame(
        [("antiheal", "enemy", "ana", 0), ("asleep", "enemy", "ana", 0)], CAUSES
    )
    lived = spark.createDataFrame([("asleep", SECOND // 2)], "effect string, lead_us bigint")
    caps = {"antiheal": (4 * SECOND, 39 * tick)}
    got = player_effects(labels, causes, caps, lived, PlayerRules()).collect()
    assert sorted((r.side, r.who, r.t // tick, int(r.detail) // tick) for r in got) == [
        ("left", "antiheal", 20, 30), ("left", "antiheal", 120, 160),
    ]


def test_round_properties(spark):
    def stretch(attr, label, first, last):
        return [(1, n * SECOND, attr, label) for n in range(first, last)]

    rows = (
        stretch("point_status", "Assault_1", 0, 10) + stretch("point_status", "Assault_2", 10, 20)
        + stretch("point_status", "Assault_3", 20, 21)  # too short
        + stretch("point_status", "Assault_1", 21, 30) + stretch("point_status", "Assault_2", 30, 40)
        + stretch("point_status", "Control_neither", 40, 50) + stretch("point_status", "Control_right", 50, 60)
        + stretch("overtime", "none", 0, 30) + stretch("overtime", "overtime", 30, 36)
        + stretch("overtime", "none", 36, 60)
    )
    labels = spark.createDataFrame(rows, "round bigint, t bigint, attr string, label string")
    numbers = spark.createDataFrame([(1, 3)], "round bigint, round_number bigint")
    got = round_properties(labels, numbers, tick=0).collect()
    assert sorted((r.kind, r.t // SECOND, r.detail) for r in got) == [
        ("flip", 50, "R"), ("gain", 10, "3"), ("overtime", 30, str(35 * SECOND)),
    ]
    none = round_properties(labels.limit(0), numbers).collect()
    assert none == []
