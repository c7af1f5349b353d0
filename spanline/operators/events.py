"""Noisy event observations: repair, validation, merging, attribution.

An observation row has ``t`` and the event fields ``first_hero, first_side,
assists (array), ability, environmental, headshot, second_hero, second_side``;
an unknown entity is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.operators.folds import episodes, timeline_fold
from spanline.operators.joins import covered_until
from spanline.ordered import LastN, Layout, Prev, RunSum, nearest_rows, scan

# How long an entry of the feed stays visible, how far two sightings
# of one event may lie apart, and the longest merged event.
MERGE_GAP = 3_000_000
MERGE_CAP = 8_000_000
NPC_SPAN = 7_300_000
NPC_CAP = 7_500_000
NPC_MIN_TARGET = 600_000
NPC_MIN = 2_000_000


def is_npc(col: str | Column, npcs: Sequence[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(*npcs)


def repair_event(
    df: DataFrame,
    abilities: DataFrame,
    deflector: str = "genji",
) -> DataFrame:
    """Fix what a misread observation still tells.

    A missing killer takes the first assist; a ``headshot`` suffix moves to the
    flag; ``resurrect`` takes the first side for both; an ability the hero does not
    have becomes ``deflect`` for the deflecting hero and marks the row ``unknown``
    for others.  ``abilities`` is ``(hero, allowed array)``.
    """
    no_killer = F.col("first_hero").isNull() & (F.size("assists") > 0)
    df = df.withColumns(
        {
            "first_hero": F.when(
                no_killer, F.regexp_replace(F.try_element_at("assists", F.lit(1)), "_assist$", "")
            ).otherwise(F.col("first_hero")),
            "assists": F.when(no_killer, F.slice("assists", 2, F.greatest(F.size("assists"), F.lit(1))))
            .otherwise(F.col("assists")),
        }
    )
    shot = F.col("ability").endswith(" headshot")
    df = df.withColumns(
        {
            "headshot": F.when(shot, F.lit(True)).otherwise(F.col("headshot")),
            "ability": F.regexp_replace("ability", " headshot$", ""),
        }
    )
    df = df.withColumn(
        "second_side",
        F.when(
            F.col("first_hero").isNotNull() & (F.col("ability") == "resurrect"),
            F.col("first_side"),
        ).otherwise(F.col("second_side")),
    )
    dim = abilities.select(F.col("hero").alias("first_hero"), F.col("allowed").alias("_allowed"))
    df = df.join(dim, "first_hero", "left")
    fits = (
        F.col("ability").isin("primary", "melee")
        | F.coalesce(F.array_contains("_allowed", F.col("ability")), F.lit(False))
        | F.col("first_hero").isNull()
    )
    return df.withColumns(
        {
            "ability_known": fits | (F.col("first_hero") == deflector),
            "ability": F.when(~fits & (F.col("first_hero") == deflector), F.lit("deflect"))
            .otherwise(F.col("ability")),
        }
    ).drop("_allowed")


def valid_observation(
    obs: DataFrame,
    hero_iv: DataFrame,
    alive_iv: DataFrame,
    npc_dim: DataFrame,
    keys: Sequence[str],
    layout: Layout | None = None,
) -> DataFrame:
    """Observations the player timelines do not contradict.

    A known killer's side is known, its ability fits and its hero is on that team
    then; an unknown killer only comes with ``primary``.  The victim side is known
    and the victim hero (for an NPC its owner) is on that team then; a hero must
    not be alive, unless resurrected.  ``hero_iv`` and ``alive_iv`` carry ``side``
    and the hero in ``status``; ``alive_iv`` only holds living stretches.
    """
    keys = list(keys)
    sides = F.col("second_side").isin("left", "right")
    known = F.col("first_hero").isNotNull()
    df = obs.filter(
        sides
        & (
            (known & F.col("first_side").isin("left", "right") & F.col("ability_known"))
            | (~known & (F.col("ability") == "primary"))
        )
    )
    npc = npc_dim.select(F.col("npc").alias("second_hero"), F.col("hero").alias("_owner"))
    df = df.join(npc, "second_hero", "left").withColumn(
        "_victim", F.coalesce("_owner", "second_hero")
    )

    def keyed(iv: DataFrame, side: str, hero: str) -> DataFrame:
        return iv.select(
            *keys, F.col("side").alias(side), F.col("status").alias(hero), "b", "e"
        )

    def here(until: str) -> Column:
        return F.coalesce(F.col(until) >= F.col("t"), F.lit(False))

    killers = [*keys, "first_side", "first_hero"]
    df = covered_until(df, keyed(hero_iv, "first_side", "first_hero"), killers, "t", layout)
    df = df.withColumn("_killer_on", here("_until")).drop("_until")
    # presence and life of the victim share key and time: one pass over both tables
    played = keyed(hero_iv, "second_side", "_victim").withColumn("_life", F.lit(False))
    lived = keyed(alive_iv, "second_side", "_victim").withColumn("_life", F.lit(True))
    df = nearest_rows(
        df,
        played.unionByName(lived),
        [*keys, "second_side", "_victim"],
        "t",
        "b",
        highest={
            "_on_until": lambda r: F.when(~r["_life"], r["e"]),
            "_alive_until": lambda r: F.when(r["_life"], r["e"]),
        },
        layout=layout,
    ).withColumns({"_victim_on": here("_on_until"), "_alive": here("_alive_until")})
    ok = (
        (F.col("first_hero").isNull() | F.col("_killer_on"))
        & F.col("_victim_on")
        & (F.col("_owner").isNotNull() | (F.col("ability") == "resurrect") | ~F.col("_alive"))
    )
    return df.filter(ok).select(*obs.columns)


def dedup_observations(
    df: DataFrame,
    keys: Sequence[str],
    event: Sequence[str],
    t: str = "t",
    gap: int = 500_000,
    layout: Layout | None = None,
) -> DataFrame:
    """Sightings of the same event within ``gap`` of the last one are one event
    ``(keys, event..., b, duration, n)``."""
    by = [*keys, *event]
    layout = layout or Layout.inspect(df, by)
    df = scan(df, by, [t], {"_pt": Prev(t)}, layout, True)
    new = F.col("_pt").isNull() | (F.col(t) - F.col("_pt") > gap)
    df = df.withColumn("_new", new.cast("bigint")).drop("_pt")
    df = scan(df, by, [t], {"_run": RunSum("_new")}, layout)
    return (
        df.groupBy(*by, "_run")
        .agg(
            F.min(t).alias("b"),
            (F.max(t) - F.min(t)).alias("duration"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("_run")
    )


def _loose_key(df: DataFrame, npcs: Sequence[str]) -> DataFrame:
    """Fields close events must share: the killer only counts for hero victims."""
    npc = is_npc("second_hero", npcs)
    return df.withColumns(
        {
            "_k1": F.when(~npc, F.coalesce("first_hero", F.lit(""))),
            "_k2": F.when(~npc, F.coalesce("first_side", F.lit(""))),
            "_npc": npc,
        }
    )


_LOOSE = ["second_hero", "second_side", "_k1", "_k2", "_npc"]


def _close(a: dict, b: dict) -> bool:
    """Rows of one loose key are close unless two known killers of an NPC differ."""
    if not a["_npc"] or a["first_hero"] is None or b["first_hero"] is None:
        return True
    return a["first_hero"] == b["first_hero"]


def merge_similar(
    df: DataFrame,
    keys: Sequence[str],
    npcs: Sequence[str],
    gap: int = MERGE_GAP,
    cap: int = MERGE_CAP,
    layout: Layout | None = None,
) -> DataFrame:
    """Greedy merge of close events ``(keys, event..., b, duration)`` in time order.

    An event joins the first kept one that is close, ends within ``gap`` of its
    begin and stays below ``cap`` together with it; durations add up and the longer
    one's fields win.  One inside a kept close event is dropped.  Only events of
    one victim and killer can meet, and none later than ``max(end, begin + cap)``
    plus ``gap``, so the fold runs per such episode.
    """
    data = [c for c in df.columns if c not in keys]
    loose = _loose_key(df, npcs)
    by = [*keys, *_LOOSE]
    end = F.col("b") + F.greatest(F.col("duration"), F.lit(cap)) + gap
    cut = episodes(loose, by, ["b", "duration", "ord"], "b", end, layout)

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        kept: list[dict] = []
        for row in rows:
            # one that ends too early for this row is out of reach of all later ones
            gone = [o for o in kept if row["b"] > o["b"] + max(o["duration"], cap) + gap]
            if gone:
                yield from gone
                kept = [o for o in kept if row["b"] <= o["b"] + max(o["duration"], cap) + gap]
            for other in kept:
                stop = other["b"] + other["duration"]
                if not _close(row, other):
                    continue
                total = other["duration"] + row["duration"]
                if abs(stop - row["b"]) <= gap and total < cap:
                    longer, shorter = (
                        (row, other) if row["duration"] > other["duration"] else (other, row)
                    )
                    fill = longer["first_hero"] is None and longer["first_side"] in ("left", "right")
                    start = other["b"]
                    first_ord = other["ord"]
                    hero = shorter["first_hero"] if fill else longer["first_hero"]
                    other.update({f: longer[f] for f in data if f not in ("b", "duration")})
                    other.update(b=start, duration=total, first_hero=hero, ord=first_ord)
                    break
                if stop > row["b"] > other["b"]:
                    break
            else:
                kept.append(dict(row))
        yield from kept

    columns = [*keys, *data]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return timeline_fold(
        cut, [*by, "_episode"], ["b", "duration", "ord"], fold, schema, F.lit(True)
    )


def merge_npc(
    df: DataFrame,
    keys: Sequence[str],
    npcs: Sequence[str],
    span: int = NPC_SPAN,
    cap: int = NPC_CAP,
    min_target: int = NPC_MIN_TARGET,
    min_dur: int = NPC_MIN,
    layout: Layout | None = None,
) -> DataFrame:
    """Merge close events of one NPC into spans and keep those over ``min_dur``.

    A kept event of at least ``min_target`` and under ``cap`` takes in a close one
    that ends within ``span`` of its begin and then lasts to that end.
    """
    data = [c for c in df.columns if c not in keys]
    loose = _loose_key(df, npcs)
    by = [*keys, *_LOOSE]
    cut = episodes(loose, by, ["b", "ord"], "b", F.col("b") + span, layout)

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        kept: list[dict] = []
        newest = None
        for row in rows:
            stop = row["b"] + row["duration"]
            gone = [o for o in kept if row["b"] > o["b"] + span]
            if gone:
                yield from (o for o in gone if o["duration"] > min_dur)
                kept = [o for o in kept if row["b"] <= o["b"] + span]
            for other in kept:
                if other["duration"] < min_target or not _close(row, other):
                    continue
                if stop < other["b"] + span and other["duration"] < cap:
                    other["duration"] = stop - other["b"]
                    break
            else:
                if row["b"] != newest:
                    kept.append(dict(row))
                    newest = row["b"]
        yield from (o for o in kept if o["duration"] > min_dur)

    columns = [*keys, *data]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return timeline_fold(
        cut, [*by, "_episode"], ["b", "ord"], fold, schema, F.col("duration") > min_dur
    )


def feed_at(
    points: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    window: int = NPC_SPAN,
    k: int = 6,
    tie: str = "event_id",
    value: str = "event_id",
    layout: Layout | None = None,
) -> DataFrame:
    """What is visible at ``t``: the newest ``k`` events of ``[t - window, t]``, newest first.

    Each event carries the array of the last ``k``, so a point needs one lookup.
    """
    ev = events.select(*keys, F.col(t).alias("_t"), F.col(tie).alias("_id"), F.col(value).alias("_v"))
    ev = scan(
        ev, keys, ["_t", "_id"], {"_last": LastN(F.struct("_t", "_v"), k)}, layout
    ).select(*keys, "_t", "_id", "_last")
    hit = nearest_rows(points, ev, keys, t, "_t", before="_f", tie="_id", layout=layout)
    shown = F.filter("_f._last", lambda x: x["_t"] >= F.col(t) - window)
    entries = F.transform(F.reverse(shown), lambda x: x["_v"])
    return hit.withColumn(
        "visible", F.coalesce(entries, F.array().cast(f"array<{events.schema[value].dataType.simpleString()}>"))
    ).drop("_f")


def feed_evidence(
    feed: DataFrame,
    ends: DataFrame,
    keys: Sequence[str],
    min_seen: int = 500_000,
    near_end: int = 1_000_000,
) -> DataFrame:
    """Feed entries that count as evidence: seen for ``min_seen``, or so late that the round's
    end may have cut them off (it comes within ``near_end`` of them).  ``ends``: ``(keys, end)``,
    one row per round."""
    stop = ends.select(*keys, F.col("end").alias("_end"))
    seen = F.col("duration") >= min_seen
    late = F.col("_end") - (F.col("b") + F.col("duration")) <= near_end
    return feed.join(stop, list(keys)).filter(seen | late).drop("_end")


def within_round(df: DataFrame, ends: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Rows up to their round's end."""
    stop = ends.select(*keys, F.col("end").alias("_end"))
    return df.join(stop, list(keys)).filter(F.col(t) <= F.col("_end")).drop("_end")


def attribute_deaths(
    deaths: DataFrame,
    feed: DataFrame,
    keys: Sequence[str],
    max_us: int = 7_000_000,
    layout: Layout | None = None,
) -> DataFrame:
    """Deaths with the nearest feed entry for the same victim by the other side.

    A death without one within ``max_us`` has no killer.  Two deaths that claim one
    entry at one time count once.  ``deaths``: ``(keys, side, hero, t)``; ``feed``:
    ``(keys, first_hero, first_side, second_hero, second_side, ability, b, duration)``.
    """
    from spanline.operators.joins import nearest_event
    from spanline.operators.votes import dedup_by_key

    other = feed.filter(~F.col("first_side").eqNullSafe(F.col("second_side"))).select(
        *keys,
        F.col("second_side").alias("side"),
        F.col("second_hero").alias("hero"),
        "first_hero",
        "first_side",
        "ability",
        F.col("b").alias("t"),
        "duration",
    )
    hit = nearest_event(deaths, other, [*keys, "side", "hero"], "t", max_us, layout=layout)
    m = F.col("match")
    out = hit.select(
        *keys,
        F.least("t", m["t"]).alias("t"),
        "side",
        "hero",
        m["first_hero"].alias("first_hero"),
        m["first_side"].alias("first_side"),
        m["ability"].alias("ability"),
        m["duration"].alias("duration"),
    )
    return dedup_by_key(
        out, [*keys, "t", "hero", "side"], ["first_hero", "first_side", "ability", "duration"]
    )



def collapse_ids(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    id_col: str,
    blank: int = 0,
    layout: Layout | None = None,
) -> DataFrame:
    """Rows of id sequences without blanks and immediate repeats; for sequences of any length."""
    df = scan(df, keys, order, {"_p": Prev(id_col)}, layout)
    return df.filter((F.col(id_col) != blank) & ~F.col(id_col).eqNullSafe(F.col("_p"))).drop("_p")
