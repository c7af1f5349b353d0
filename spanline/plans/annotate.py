"""From player labels and feed observations of rounds to annotated rounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.operators import derive, events
from spanline.operators.intervals import (
    anchor_smooth,
    filter_min_duration,
    run_length_encode,
)
from spanline.operators.joins import state_at
from spanline.operators.votes import nest_rounds
from spanline.ordered import Layout
from spanline.session import cut_lineage
from spanline.timeunits import SECOND


@dataclass(frozen=True)
class PlayerRules:
    """Durations of the player rules, in microseconds."""

    tick: int = SECOND // 10
    hero: int = SECOND // 2
    alive: int = SECOND
    revive: int = 98 * SECOND // 10
    death_delay: int = 3 * SECOND // 10
    switch_gap: int = 5 * SECOND
    charge_gap: int = 3 * SECOND
    same_hero_after: int = 2 * SECOND
    near_start: int = SECOND
    long_after: int = 10 * SECOND
    seen_again: int = SECOND // 2
    merge_gap: int = 3 * SECOND
    merge_cap: int = 8 * SECOND
    attribute: int = 7 * SECOND
    min_seen: int = SECOND // 2
    near_end: int = SECOND
    npc_span: int = 73 * SECOND // 10
    npc_cap: int = 75 * SECOND // 10
    npc_target: int = 6 * SECOND // 10
    npc_least: int = 2 * SECOND

    def scaled(self, factor: int) -> "PlayerRules":
        return PlayerRules(**{k: v * factor for k, v in self.__dict__.items()})


def clean_timelines(
    labels: DataFrame, rules: PlayerRules, order: Sequence[str], layout: Layout
) -> dict[str, DataFrame]:
    """Intervals of the hero and alive attributes, cleaned, and of charge and status per player slot."""
    keys = ["round", "side", "slot"]

    # One pass over the samples encodes every attribute; the intervals are far fewer
    # and used several times, so they are written once, and so are cleaned timelines.
    encoded = cut_lineage(
        run_length_encode(labels, [*keys, "attr"], "t", "label", order, layout).drop("n")
    )

    def raw(attr: str) -> DataFrame:
        return encoded.filter(F.col("attr") == attr).drop("attr")

    alive = {"alive": rules.alive, "dead": rules.alive}
    return {
        "hero": cut_lineage(anchor_smooth(raw("hero"), keys, rules.hero, layout=layout)),
        "alive": cut_lineage(filter_min_duration(raw("alive"), keys, alive, layout=layout)),
        "charge": raw("charge"),
        "status": raw("status"),
    }


def annotate_rounds(
    labels: DataFrame,
    observations: DataFrame,
    abilities: DataFrame,
    npcs: DataFrame,
    npc_names: Sequence[str],
    rules: PlayerRules | None = None,
    order: Sequence[str] = (),
    deflector: str = "genji",
    layout: Layout | None = None,
    ends: DataFrame | None = None,
    denied: tuple[Sequence[str], Sequence[str]] = ((), ()),
    lines: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """All events of all rounds as ``(round, t, kind, side, slot, who, detail)``.

    Timelines are cleaned per slot; deaths, revives, switches and charges follow
    from them; feed observations are checked against them, de-duplicated, merged
    and attributed to the deaths.  Entries whose victim is no player, or a charge of
    ``denied[0]`` ended by an ability of ``denied[1]``, become spans of their own.  One
    victim has one event at one time: kills go before NPC spans, those before
    resurrections.  ``ends (round, end)`` bounds deaths and weighs short entries.  ``lines``
    are the :func:`clean_timelines` of ``labels``, where the caller has them.
    """
    rules = rules or PlayerRules()
    slots = ["round", "side", "slot"]
    layout = layout or Layout.inspect(labels, ["round"])
    lines = lines or clean_timelines(labels, rules, order, layout)
    hero, alive, charge = lines["hero"], lines["alive"], lines["charge"]
    dead = alive.filter(F.col("status") == "dead").select(*slots, "b", "e")

    deaths = derive.deaths(alive, hero, slots, rules.death_delay, layout=layout)
    revives = derive.revives(alive, slots, rules.revive, layout=layout)
    switches = derive.switches(hero, dead, slots, rules.switch_gap, rules.tick, layout)
    charges = derive.lifecycle(
        charge, slots, ("no_ult", "has_ult", "using_ult"), hero,
        max_gap=rules.charge_gap, tick=rules.tick, same_hero_after=rules.same_hero_after,
        near_start=rules.near_start, long_after=rules.long_after, layout=layout,
    )

    living = (
        alive.filter(F.col("status") == "alive")
        .withColumnRenamed("b", "t")
        .drop("status")
    )
    living = state_at(living, hero, slots, "t", layout=layout).select(
        "round", "side", "status", F.col("t").alias("b"), "e"
    )
    repaired = events.repair_event(observations, abilities, deflector)
    valid = events.valid_observation(
        repaired, hero.select("round", "side", "status", "b", "e"), living, npcs, ["round"], layout
    )
    fields = ["first_hero", "first_side", "second_hero", "second_side", "ability"]
    possible = events.dedup_observations(valid, ["round"], fields, "t", rules.seen_again, layout)
    possible = possible.drop("n").withColumn("ord", F.xxhash64("round", "b", *fields))
    feed = cut_lineage(
        events.merge_similar(
            possible, ["round"], npc_names, rules.merge_gap, rules.merge_cap, layout
        )
    )
    fallen = deaths.filter(F.col("hero").isNotNull()).select("round", "side", "hero", "t")
    evidence = feed
    if ends is not None:
        fallen = events.within_round(fallen, ends, ["round"])
        evidence = events.feed_evidence(feed, ends, ["round"], rules.min_seen, rules.near_end)
    kills = events.attribute_deaths(fallen, evidence, ["round"], rules.attribute, layout)
    charges_denied = F.col("second_hero").isin(*denied[0]) & F.col("ability").isin(*denied[1])
    apart = feed.filter(events.is_npc("second_hero", npc_names) | charges_denied)
    spans = events.merge_npc(
        apart, ["round"], [*npc_names, *denied[0]], rules.npc_span, rules.npc_cap, rules.npc_target,
        rules.npc_least, layout,
    )
    taken = kills.select("round", "t", "hero", "side")
    spans = spans.join(taken, _same_event(spans, taken), "left_anti")
    taken = taken.unionByName(
        spans.select(
            "round", F.col("b").alias("t"), F.col("second_hero").alias("hero"), F.col("second_side").alias("side")
        )
    )
    resurrections = feed.filter((F.col("ability") == "resurrect") & (F.col("duration") > 0))
    resurrections = resurrections.join(taken, _same_event(resurrections, taken), "left_anti")

    none = F.lit(None).cast("string")

    def shape(df: DataFrame, kind: str, t: str, who: str, detail) -> DataFrame:
        slot = F.col("slot") if "slot" in df.columns else F.lit(None).cast("bigint")
        side = F.col("side") if "side" in df.columns else F.col("second_side")
        return df.select(
            "round", F.col(t).alias("t"), F.lit(kind).alias("kind"), side.alias("side"),
            slot.cast("bigint").alias("slot"),
            (F.col(who) if who else none).alias("who"), detail.cast("string").alias("detail"),
        )

    parts = [
        shape(kills, "kill", "t", "hero", F.col("first_hero")),
        shape(spans, "npc", "b", "second_hero", F.col("first_hero")),
        shape(resurrections, "resurrect", "b", "second_hero", F.col("first_hero")),
        shape(revives, "revive", "t", "", none),
        shape(switches, "switch", "b", "hero", F.col("e")),
        shape(charges, "charge", "gained", "", F.col("used")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def player_effects(
    labels: DataFrame,
    causes: DataFrame,
    caps: Mapping[str, tuple[int, int]],
    alive_rules: DataFrame,
    rules: PlayerRules | None = None,
    order: Sequence[str] = (),
    normal: str = "normal",
    layout: Layout | None = None,
    lines: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Status effects of all players, shaped like the events of :func:`annotate_rounds`.

    ``labels`` hold the attributes hero, alive and status per slot.  An effect needs a cause
    among the heroes of its round (``causes``: effect, relation, cause, lead_us) and, where
    ``alive_rules (effect, lead_us)`` name it, a living victim; ``who`` is the effect,
    ``detail`` its exclusive end.  ``lines`` are the :func:`clean_timelines` of ``labels``.
    """
    rules = rules or PlayerRules()
    slots = ["round", "side", "slot"]
    layout = layout or Layout.inspect(labels, ["round"])
    lines = lines or clean_timelines(labels, rules, order, layout)
    seen = lines["status"]
    alive = lines["alive"].filter(F.col("status") == "alive")
    found = derive.effects(
        seen, lines["hero"], causes, ["round"], caps, rules.tick, normal, layout, alive, alive_rules
    )
    return found.select(
        "round", F.col("b").alias("t"), F.lit("effect").alias("kind"), "side",
        F.col("slot").cast("bigint").alias("slot"), F.col("status").alias("who"),
        F.col("e").cast("string").alias("detail"),
    )


# fixed values: points that a round of a mode can give, others give three
POINTS = {"Assault": 2}


def round_properties(
    labels: DataFrame,
    numbers: DataFrame,
    least: int = 2 * SECOND,
    tick: int = SECOND // 10,
    order: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Flips, gains and overtimes of all rounds, shaped like :func:`annotate_rounds`' events.

    ``labels (round, t, attr, label)`` hold the attributes overtime and point_status, the
    latter as ``Control_<side>`` or ``<mode>_<point>``; stretches under ``least`` are noise.
    A gain is a total above all before it in its round; it takes in the points of the rounds
    before of the same side, by the ``round_number`` in ``numbers`` (1 where none is known).
    ``detail`` of a flip is the side, of a gain the total, of an overtime its exclusive end.
    """
    keys = ["round"]
    layout = layout or Layout.inspect(labels, keys)

    def seen(attr: str) -> DataFrame:
        own = labels.filter(F.col("attr") == attr)
        return run_length_encode(own, keys, "t", "label", order, layout).drop("n")

    def shape(df: DataFrame, kind: str, detail) -> DataFrame:
        none = F.lit(None)
        return df.select(
            "round", "t", F.lit(kind).alias("kind"), none.cast("string").alias("side"),
            none.cast("bigint").alias("slot"), none.cast("string").alias("who"),
            detail.cast("string").alias("detail"),
        )

    points = cut_lineage(filter_min_duration(seen("point_status"), keys, least, layout=layout))
    flips = derive.control_flips(points, keys)
    mode, point = (F.regexp_extract("status", r"^([^_]+)_([0-9]+)$", n) for n in (1, 2))
    each = F.lit(3)
    for name, n in POINTS.items():
        each = F.when(mode == name, n).otherwise(each)
    before = each * F.floor((F.coalesce("round_number", F.lit(1)) - 1) / 2)
    totals = (
        points.filter(~F.col("status").startswith("Control") & (point != ""))
        .withColumn("_gained", point.cast("bigint") - 1)
        .filter(F.col("_gained") > 0)
        .join(numbers.select("round", "round_number"), "round", "left")
        .select("round", F.col("b").alias("t"), (F.col("_gained") + before).alias("total"))
    )
    gains = derive.rising_only(totals, keys, ["t", "total"], "total", layout)
    overtimes = derive.overtime_spans(seen("overtime"), keys, "overtime", least, tick, layout)
    return (
        shape(flips, "flip", F.col("side"))
        .unionByName(shape(gains, "gain", F.col("total")))
        .unionByName(shape(overtimes.withColumnRenamed("b", "t"), "overtime", F.col("e")))
    )


def _same_event(feed: DataFrame, taken: DataFrame):
    return (
        (feed["round"] == taken["round"])
        & (feed["b"] == taken["t"])
        & (feed["second_hero"] == taken["hero"])
        & (feed["second_side"] == taken["side"])
    )


def round_documents(annotated: DataFrame) -> DataFrame:
    """One document per round with its events in time order."""
    return nest_rounds(
        annotated, ["round"], ["t", "kind", "side", "slot"], ["who", "detail"], "events"
    )
