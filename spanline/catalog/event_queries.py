"""Event observations, top-k and set operations (PRJ-11, FLT-01, W-10 .. W-13, TK-*, SO-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import (
    FRAMES,
    GRP,
    IV,
    events_layout,
    frames,
    iv,
    table,
)
from spanline.operators import events as ev
from spanline.operators import tables as tb
from spanline.session import small_table
from spanline.timeunits import DAY, HOUR

HEROES = ["click", "view", "error", "purchase", "signup"]

OBS = """obs as (select grp // 2 as round, t + 3600000000 as t, event_id,
  case when k % 11 = 0 then null else label end as first_hero,
  case when k % 13 = 0 then 'neither' when grp % 2 = 0 then 'left' else 'right' end as first_side,
  case when k % 3 = 0 then ['view_assist', 'error_assist'] else [] end as assists,
  case k % 8 when 0 then 'primary' when 1 then 'melee' when 2 then label || '_a' when 3 then 'resurrect'
     when 4 then 'primary headshot' when 5 then 'click_a' when 6 then 'primary' else 'view_a headshot' end as ability,
  k % 17 = 0 as headshot,
  ['click', 'view', 'error', 'purchase', 'signup', 'turret'][k % 6 + 1] as second_hero,
  case when k % 19 = 0 then null when k % 2 = 0 then 'left' else 'right' end as second_side
  from frames)"""

REPAIRED = """r1 as (select * replace (
     case when first_hero is null and len(assists) > 0 then regexp_replace(assists[1], '_assist$', '')
          else first_hero end as first_hero,
     case when first_hero is null and len(assists) > 0 then assists[2:] else assists end as assists,
     headshot or suffix(ability, ' headshot') as headshot,
     regexp_replace(ability, ' headshot$', '') as ability) from obs),
r2 as (select * replace (case when first_hero is not null and ability = 'resurrect' then first_side
     else second_side end as second_side),
   ability in ('primary', 'melee') or ability = first_hero || '_a'
     or (first_hero = 'view' and ability = 'resurrect') or first_hero is null as fits from r1),
rep as (select * replace (case when not coalesce(fits, true) and first_hero = 'error' then 'deflect'
     else ability end as ability), coalesce(fits, true) or first_hero = 'error' as ability_known from r2)"""


def observations(spark, sf):
    k = F.col("k")
    return frames(spark, sf).select(
        F.floor(F.col("grp") / 2).alias("round"),
        (F.col("t") + HOUR).alias("t"),
        "event_id",
        F.when(k % 11 != 0, F.col("label")).alias("first_hero"),
        F.when(k % 13 == 0, "neither")
        .when(F.col("grp") % 2 == 0, "left")
        .otherwise("right")
        .alias("first_side"),
        F.when(k % 3 == 0, F.array(F.lit("view_assist"), F.lit("error_assist")))
        .otherwise(F.array().cast("array<string>"))
        .alias("assists"),
        F.when(k % 8 == 0, "primary")
        .when(k % 8 == 1, "melee")
        .when(k % 8 == 2, F.concat("label", F.lit("_a")))
        .when(k % 8 == 3, "resurrect")
        .when(k % 8 == 4, "primary headshot")
        .when(k % 8 == 5, "click_a")
        .when(k % 8 == 6, "primary")
        .otherwise("view_a headshot")
        .alias("ability"),
        (k % 17 == 0).alias("headshot"),
        F.element_at(F.array(*[F.lit(h) for h in [*HEROES, "turret"]]), k % 6 + 1).alias(
            "second_hero"
        ),
        F.when(k % 19 == 0, F.lit(None))
        .when(k % 2 == 0, "left")
        .otherwise("right")
        .alias("second_side"),
    )


def abilities(spark):
    rows = [(h, [f"{h}_a", "resurrect"] if h == "view" else [f"{h}_a"]) for h in HEROES]
    return small_table(spark, rows, "hero string, allowed array<string>")


def repaired(spark, sf):
    return ev.repair_event(observations(spark, sf), abilities(spark), "error")


@query(
    "prj11_repair_event",
    f"""with {FRAMES}, {OBS}, {REPAIRED}
select event_id, round, t, first_hero, first_side, array_to_string(assists, ',') as assists, ability,
  headshot, second_hero, second_side, ability_known from rep""",
)
def repair_event(spark, sf):
    return repaired(spark, sf).select(
        "event_id", "round", "t", "first_hero", "first_side",
        F.array_join("assists", ",").alias("assists"), "ability", "headshot", "second_hero",
        "second_side", "ability_known",
    )


def _sides(spark, sf):
    return iv(spark, sf).select(
        F.floor(F.col("grp") / 2).alias("round"),
        F.when(F.col("grp") % 2 == 0, "left").otherwise("right").alias("side"),
        "status", "b", "e",
    )


def valid_feed(spark, sf):
    heroes = _sides(spark, sf).withColumn("e", F.col("e") + 12 * HOUR)
    alive = _sides(spark, sf).filter(F.col("e") > F.col("b"))
    npcs = small_table(spark, [("turret", "click")], "npc string, hero string")
    return ev.valid_observation(
        repaired(spark, sf), heroes, alive, npcs, ["round"], events_layout(spark, sf)
    )


@query(
    "flt01_valid_observation",
    f"""with {IV}, {OBS}, {REPAIRED},
s as (select grp // 2 as round, case when grp % 2 = 0 then 'left' else 'right' end as side, status, b, e from iv),
hero as (select round, side, status, b, e + 43200000000 as e from s),
alive as (select * from s where e > b),
v as (select *, case when second_hero = 'turret' then 'click' else second_hero end as victim from rep)
select event_id, round, t, first_hero, ability, second_hero, second_side from v
where second_side in ('left', 'right')
  and case when first_hero is null then ability = 'primary'
      else first_side in ('left', 'right') and ability_known and exists (select 1 from hero h
        where h.round = v.round and h.side = v.first_side and h.status = v.first_hero
          and v.t between h.b and h.e) end
  and exists (select 1 from hero h where h.round = v.round and h.side = v.second_side
        and h.status = v.victim and v.t between h.b and h.e)
  and (second_hero = 'turret' or ability = 'resurrect' or not exists (select 1 from alive a
        where a.round = v.round and a.side = v.second_side and a.status = v.victim
          and v.t between a.b and a.e))""",
)
def valid_observation(spark, sf):
    return valid_feed(spark, sf).select(
        "event_id", "round", "t", "first_hero", "ability", "second_hero", "second_side"
    )


@query(
    "flt02_is_npc",
    "select event_id, event_type in ('error', 'signup') as npc from events",
)
def is_npc(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", ev.is_npc("event_type", ["error", "signup"]).alias("npc")
    )


@query(
    "w10_dedup_observations",
    f"""with {FRAMES}, f as (select grp, label, k % 5 as kk, t from frames),
g as (select *, sum(case when t - p <= 86400000000 then 0 else 1 end) over (partition by grp, label, kk
   order by t rows unbounded preceding) as run
   from (select *, lag(t) over (partition by grp, label, kk order by t) as p from f))
select grp, label, kk, min(t) as b, max(t) - min(t) as duration, count(*) as n from g
group by grp, label, kk, run""",
)
def dedup_observations(spark, sf):
    f = frames(spark, sf).select("grp", "label", (F.col("k") % 5).alias("kk"), "t")
    return ev.dedup_observations(
        f, GRP, ["label", "kk"], "t", DAY, events_layout(spark, sf)
    )


def _possible(spark, sf):
    """De-duplicated observations of every round, scaled so that merges happen."""
    v = observations(spark, sf).filter(F.col("second_side").isNotNull())
    fields = ["first_hero", "first_side", "second_hero", "second_side"]
    lay = events_layout(spark, sf)
    p = ev.dedup_observations(v, ["round"], fields, "t", 6 * HOUR, lay)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ["round", "b", *fields]]
    return p.drop("n").withColumn("ord", F.md5(F.concat_ws("|", *parts)))


POSSIBLE = """p0 as (select round, first_hero as h, first_side as hs, second_hero as v, second_side as vs, t,
   lag(t) over (partition by round, first_hero, first_side, second_hero, second_side order by t) as p
   from obs where second_side is not null),
p1 as (select *, sum(case when t - p <= 21600000000 then 0 else 1 end) over (partition by round, h, hs, v, vs
   order by t rows unbounded preceding) as run from p0),
p2 as (select round, h, hs, v, vs, min(t) as b, max(t) - min(t) as d, v = 'turret' as npc
   from p1 group by round, h, hs, v, vs, run),
possible as (select *, md5(concat(round, '|', b, '|', coalesce(h, ''), '|', hs, '|', v, '|', vs)) as ord,
   case when npc then null else coalesce(h, '') end as k1, case when npc then null else hs end as k2 from p2)"""


def _folded(where: str, order: str, find: str, change: str, push: str) -> str:
    """A fold over lists: ``k`` holds the kept rows, ``x[1]`` is the next one, ``q`` a kept one.

    The first kept row for which ``find`` holds becomes ``change``; without one, ``x`` is
    added if ``push`` holds.
    """
    near = "(not x[1].npc or x[1].h is null or q.h is null or x[1].h = q.h)"
    at = f"coalesce(list_position(list_transform(k, lambda q: coalesce({near} and {find}, false)), true), 0)"
    return f"""folded as (select round, unnest(list_reduce(list([{{'h': h, 'hs': hs, 'v': v, 'vs': vs, 'b': b, 'd': d,
    'npc': npc}}] order by {order}), lambda k, x: case when {at} = 0 and {push} then list_concat(k, x)
    when {at} = 0 then k else list_transform(k, lambda q, i: case when i = {at} then {change} else q end) end)) as r
  from possible where {where} group by round, v, vs, k1, k2, npc)"""


SIMILAR = _folded(
    "true",
    "b, d, ord",
    """((abs(q.b + q.d - x[1].b) <= 86400000000 and q.d + x[1].d < 172800000000)
      or (q.b + q.d > x[1].b and x[1].b > q.b))""",
    """case when abs(q.b + q.d - x[1].b) <= 86400000000 and q.d + x[1].d < 172800000000 then
      {'h': case when x[1].d > q.d then case when x[1].h is null and x[1].hs in ('left', 'right') then q.h else x[1].h end
            else case when q.h is null and q.hs in ('left', 'right') then x[1].h else q.h end end,
       'hs': case when x[1].d > q.d then x[1].hs else q.hs end, 'v': q.v, 'vs': q.vs, 'b': q.b, 'd': q.d + x[1].d,
       'npc': q.npc} else q end""",
    "true",
)
SPANS = _folded(
    "npc",
    "b, ord",
    "q.d >= 0 and x[1].b + x[1].d < q.b + 259200000000 and q.d < 270000000000",
    "{'h': q.h, 'hs': q.hs, 'v': q.v, 'vs': q.vs, 'b': q.b, 'd': x[1].b + x[1].d - q.b, 'npc': q.npc}",
    "not list_contains(list_transform(k, lambda q: q.b), x[1].b)",
)
FOLDED_ROWS = """select round, r.h as first_hero, r.hs as first_side, r.v as second_hero, r.vs as second_side,
  r.b as b, r.d as duration from folded"""


@query("w11_merge_similar", f"with {FRAMES}, {OBS}, {POSSIBLE}, {SIMILAR} {FOLDED_ROWS}")
def merge_similar(spark, sf):
    return ev.merge_similar(
        _possible(spark, sf), ["round"], ["turret"], 24 * HOUR, 48 * HOUR,
        events_layout(spark, sf),
    ).drop("ord")


@query(
    "w12_merge_npc",
    f"with {FRAMES}, {OBS}, {POSSIBLE}, {SPANS} {FOLDED_ROWS} where r.d > 3600000000",
)
def merge_npc(spark, sf):
    p = _possible(spark, sf).filter(F.col("second_hero") == "turret")
    return ev.merge_npc(
        p, ["round"], ["turret"], 72 * HOUR, 75 * HOUR, 0, HOUR, events_layout(spark, sf)
    ).drop("ord")


@query(
    "w13_feed_at",
    f"""with {FRAMES}, p as (select grp, event_id as pid, t + 3600000000 as t from frames),
j as (select p.grp, p.pid, p.t, f.event_id, row_number() over (partition by p.pid
   order by f.t desc, f.event_id desc) as rn from p left join frames f on f.grp = p.grp
   and f.t between p.t - 86400000000 and p.t)
select grp, pid, t, coalesce(string_agg(event_id::varchar, ',' order by rn), '') as visible
from j where rn <= 6 group by 1, 2, 3""",
)
def feed_at(spark, sf):
    f = frames(spark, sf)
    p = f.select("grp", F.col("event_id").alias("pid"), (F.col("t") + HOUR).alias("t"))
    shown = ev.feed_at(
        p, f.select("grp", "t", "event_id"), GRP, "t", DAY, 6, layout=events_layout(spark, sf)
    )
    return shown.withColumn("visible", F.array_join("visible", ","))


@query(
    "jn07_attribute_deaths",
    f"""with {FRAMES}, d as (select grp // 2 as round, case when grp % 2 = 0 then 'left' else 'right' end as side,
   label as hero, t, event_id from frames where k % 2 = 0),
f as (select grp // 2 as round, case when k // 2 % 2 = 0 then 'left' else 'right' end as side, label as hero,
   'h' || (k % 3)::varchar as first_hero, case when grp % 2 = 0 then 'left' else 'right' end as first_side, t
   from frames where k % 2 = 1 and (grp % 2 = 0) <> (k // 2 % 2 = 0)),
j as (select d.*, f.first_hero, f.t as ft from d left join f on f.round = d.round and f.side = d.side
   and f.hero = d.hero and abs(f.t - d.t) <= 50400000000
   qualify row_number() over (partition by d.event_id order by abs(f.t - d.t), f.t) = 1)
select distinct round, least(t, ft) as t, side, hero, first_hero from j""",
)
def attribute_deaths(spark, sf):
    deaths, feed = _deaths_and_feed(spark, sf)
    return ev.attribute_deaths(
        deaths, feed, ["round"], 14 * HOUR, events_layout(spark, sf)
    ).select("round", "t", "side", "hero", "first_hero")


def _deaths_and_feed(spark, sf):
    f = frames(spark, sf).withColumns(
        {
            "round": F.floor(F.col("grp") / 2),
            "own": F.when(F.col("grp") % 2 == 0, "left").otherwise("right"),
            "par": F.when(F.floor(F.col("k") / 2) % 2 == 0, "left").otherwise("right"),
        }
    )
    deaths = f.filter(F.col("k") % 2 == 0).select(
        "round", F.col("own").alias("side"), F.col("label").alias("hero"), "t"
    )
    feed = f.filter(F.col("k") % 2 == 1).select(
        "round",
        F.concat(F.lit("h"), (F.col("k") % 3).cast("string")).alias("first_hero"),
        F.col("own").alias("first_side"),
        F.col("label").alias("second_hero"),
        F.col("par").alias("second_side"),
        F.lit("primary").alias("ability"),
        F.col("t").alias("b"),
        (F.col("k") % 7 * HOUR).alias("duration"),
    )
    return deaths, feed


@query(
    "flt10_feed_evidence",
    f"""with {FRAMES}, z as (select grp // 2 as round, min(t) + (max(t) - min(t)) // 4 * 3 as z from frames group by 1),
d as (select grp // 2 as round, case when grp % 2 = 0 then 'left' else 'right' end as side,
   label as hero, t, event_id from frames join z on z.round = grp // 2 where k % 2 = 0 and t <= z),
f as (select grp // 2 as round, case when k // 2 % 2 = 0 then 'left' else 'right' end as side, label as hero,
   'h' || (k % 3)::varchar as first_hero, case when grp % 2 = 0 then 'left' else 'right' end as first_side, t
   from frames join z on z.round = grp // 2 where k % 2 = 1 and (grp % 2 = 0) <> (k // 2 % 2 = 0)
   and (k % 7 >= 3 or z - (t + k % 7 * 3600000000) <= 864000000000)),
j as (select d.*, f.first_hero, f.t as ft from d left join f on f.round = d.round and f.side = d.side
   and f.hero = d.hero and abs(f.t - d.t) <= 50400000000
   qualify row_number() over (partition by d.event_id order by abs(f.t - d.t), f.t) = 1)
select distinct round, least(t, ft) as t, side, hero, first_hero from j""",
)
def feed_evidence(spark, sf):
    """Deaths up to the round's end, with entries seen for three hours or near the end."""
    deaths, feed = _deaths_and_feed(spark, sf)
    span = F.max("t") - F.min("t")
    ends = deaths.select("round", "t").unionByName(feed.select("round", F.col("b").alias("t")))
    ends = ends.groupBy("round").agg((F.min("t") + F.floor(span / 4) * 3).alias("end"))
    return ev.attribute_deaths(
        ev.within_round(deaths, ends, ["round"]),
        ev.feed_evidence(feed, ends, ["round"], 3 * HOUR, 240 * HOUR),
        ["round"], 14 * HOUR, events_layout(spark, sf),
    ).select("round", "t", "side", "hero", "first_hero")


@query(
    "tk01_chronological",
    "select event_id, epoch_us(ts) as t from events order by t, event_id",
)
def chronological(spark, sf):
    return tb.chronological(frames(spark, sf).select("event_id", "t"), "t", ["event_id"])


@query(
    "tk02_top_newest",
    f"""with {FRAMES} select grp, event_id, t from frames
qualify row_number() over (partition by grp order by t desc, event_id desc) <= 7""",
)
def top_newest(spark, sf):
    return tb.top_newest(
        frames(spark, sf).select("grp", "event_id", "t"), GRP, "t", 7, "event_id",
        events_layout(spark, sf),
    )


@query("tk03_sorted_domain", "select distinct lower(n_name) as value from nation order by value")
def sorted_domain(spark, sf):
    return tb.sorted_domain(
        table(spark, sf, "nation").select(F.lower("n_name").alias("n")), "n"
    )


@query(
    "tk04_first_n",
    f"""with {FRAMES} select grp, event_id, t from frames
qualify row_number() over (partition by grp order by t, event_id) <= 5""",
)
def first_n(spark, sf):
    return tb.first_n(
        frames(spark, sf).select("grp", "event_id", "t"), GRP, ["t", "event_id"], 5,
        events_layout(spark, sf),
    )


@query("tk05_shuffled", "select event_id from events")
def shuffled(spark, sf):
    return tb.shuffled(table(spark, sf, "events").select("event_id"), "event_id", 7)


@query(
    "so01_union_all",
    """select l_orderkey as id, 'L' as side from lineitem where l_returnflag = 'R' union all
select o_orderkey, 'R' from orders where o_orderstatus = 'F'""",
)
def union_all(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("id"), F.lit("L").alias("side")
    )
    b = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.lit("R").alias("side"), F.col("o_orderkey").alias("id")
    )
    return tb.union_all(a, b)


@query(
    "so02_union_distinct",
    """select p_type as ability from part union select p_brand from part union
select p_type || ' headshot' from part where p_size > 40""",
)
def union_distinct(spark, sf):
    p = table(spark, sf, "part")
    return tb.union_distinct(
        p.select(F.col("p_type").alias("ability")),
        p.select(F.col("p_brand").alias("ability")),
        p.filter("p_size > 40").select(F.concat("p_type", F.lit(" headshot")).alias("ability")),
    )


@query(
    "so03_distinct_on",
    """select l_orderkey, min(l_linenumber) as l_linenumber from lineitem
where l_returnflag in ('A', 'N') group by 1""",
)
def distinct_on(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    both = tb.union_all(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'N'"))
    return tb.distinct_on(both, ["l_orderkey"], ["l_linenumber", "l_returnflag"]).drop("l_returnflag")


@query(
    "so04_minus",
    """select o_custkey as id from orders except select o_custkey from orders where o_orderstatus = 'P'""",
)
def minus(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return tb.minus(o.select("id"), o.filter("o_orderstatus = 'P'").select("id"))


@query(
    "so05_common",
    """select o_custkey as id from orders where o_orderstatus = 'F' intersect
select o_custkey from orders where o_orderstatus = 'P'""",
)
def common(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return tb.common(
        o.filter("o_orderstatus = 'F'").select("id"), o.filter("o_orderstatus = 'P'").select("id")
    )


@query(
    "h33_collapse_rows",
    f"""with {FRAMES}, x as (select grp, t, event_id, k % 4 as id,
   lag(k % 4) over (partition by grp order by t, event_id) as p from frames)
select grp, t, event_id, id from x where id <> 0 and id is distinct from p""",
)
def collapse_rows(spark, sf):
    f = frames(spark, sf).select("grp", "t", "event_id", (F.col("k") % 4).alias("id"))
    return ev.collapse_ids(f, GRP, ["t", "event_id"], "id", layout=events_layout(spark, sf))
