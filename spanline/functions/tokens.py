"""Feed entries as token sequences, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanline.functions.arrays import let


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parse_event(
    tokens: str | Column,
    heroes: Sequence[str],
    abilities: Sequence[str],
    allowed: Mapping[str, Sequence[str]],
) -> Column:
    """Tokens to an event struct; the tokens were collapsed before.

    Up to the first ability: killer side, hero and assists; after it the victim.
    An ability the killer does not have becomes ``primary``.  Unknown is NULL.
    """
    # Side words, the two suffixes and the environment word.
    sides = _lit_array(["left", "right"])
    hero_set, ability_set = _lit_array(heroes), _lit_array(abilities)
    no_tokens = F.array().cast("array<string>")
    pairs = [
        v for h in heroes for v in (F.lit(h), _lit_array(allowed.get(h, [])).cast("array<string>"))
    ]
    allowed_map = F.create_map(*pairs)

    def last(arr: Column) -> Column:
        return F.try_element_at(arr, F.lit(-1))

    def cut(t: Column) -> Column:
        return F.struct(
            t.alias("t"),
            F.array_position(F.transform(t, lambda x: F.array_contains(ability_set, x)), True)
            .cast("int")
            .alias("at"),
        )

    def halves(c: Column) -> Column:
        t, at = c["t"], c["at"]
        found = at > 0
        head = F.when(found, F.slice(t, 1, F.greatest(at - 1, F.lit(0)))).otherwise(t)
        rest = F.when(found, F.slice(t, F.greatest(at, F.lit(1)), F.size(t))).otherwise(no_tokens)
        return F.struct(
            head.alias("head"),
            F.filter(rest, lambda x: ~F.array_contains(ability_set, x)).alias("tail"),
            last(F.filter(rest, lambda x: F.array_contains(ability_set, x))).alias("raw"),
        )

    def roles(h: Column) -> Column:
        victims = F.transform(h["tail"], lambda x: F.regexp_replace(x, "_assist$", ""))
        helpers = F.filter(
            h["head"],
            lambda x: ~F.array_contains(hero_set, x)
            & ~F.array_contains(sides, x)
            & ~x.endswith("npc"),
        )
        return F.struct(
            last(F.filter(h["head"], lambda x: F.array_contains(hero_set, x))).alias("killer"),
            last(F.filter(h["head"], lambda x: F.array_contains(sides, x))).alias("killer_side"),
            F.array_distinct(
                F.transform(helpers, lambda x: F.regexp_replace(x, "_assist$", ""))
            ).alias("helpers"),
            F.regexp_replace(h["raw"], " headshot$", "").alias("ability"),
            F.when(h["raw"].isNotNull(), h["raw"].endswith("headshot")).alias("headshot"),
            last(
                F.filter(victims, lambda x: x.endswith("_npc") | F.array_contains(hero_set, x))
            ).alias("victim"),
            last(F.filter(victims, lambda x: F.array_contains(sides, x))).alias("victim_side"),
        )

    def event(r: Column) -> Column:
        fits = F.array_contains(F.try_element_at(allowed_map, r["killer"]), r["ability"])
        ability = F.when(
            r["killer"].isNotNull() & ~F.coalesce(fits, F.lit(False)), F.lit("primary")
        ).otherwise(r["ability"])
        return F.struct(
            r["killer"].alias("first_hero"),
            r["killer_side"].alias("first_side"),
            F.filter(r["helpers"], lambda x: ~x.eqNullSafe(r["killer"])).alias("assists"),
            ability.alias("ability"),
            F.array_contains(_c(tokens), "environmental").alias("environmental"),
            r["headshot"].alias("headshot"),
            F.regexp_replace(r["victim"], "_npc$", "").alias("second_hero"),
            r["victim_side"].alias("second_side"),
        )

    plain = F.filter(_c(tokens), lambda x: x != "environmental")
    return let(let(let(let(plain, cut), halves), roles), event)


def encode_event(event: str | Column, heroes: Sequence[str], npcs: Sequence[str]) -> Column:
    """Event struct to its token list; empty without a victim."""
    e = _c(event)
    none = F.array().cast("array<string>")
    ability = F.coalesce(e["ability"], F.lit("primary"))
    ability = F.when(
        F.coalesce(e["headshot"], F.lit(False)) & ~ability.endswith("headshot"),
        F.concat(ability, F.lit(" headshot")),
    ).otherwise(ability)
    killer = F.when(
        e["first_hero"].isNotNull(),
        F.concat(
            F.array(e["first_side"], e["first_hero"]),
            F.transform(
                F.coalesce(e["assists"], none), lambda a: F.concat(F.lower(a), F.lit("_assist"))
            ),
        ),
    ).otherwise(none)
    env = F.when(e["environmental"], F.array(F.lit("environmental"))).otherwise(none)
    victim = F.when(
        ~e["second_hero"].isin(*heroes) & e["second_hero"].isin(*npcs),
        F.concat(e["second_hero"], F.lit("_npc")),
    ).otherwise(e["second_hero"])
    full = F.concat(killer, F.array(ability), env, F.array(victim, e["second_side"]))
    return F.when(
        e["second_hero"].isNull(), none
    ).otherwise(F.filter(full, lambda x: x.isNotNull()))
