"""The second pass over recordings: refined bounds and player names of rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.plan_queries import recording_labels, rounds_and_parts
from spanline.catalog.registry import query
from spanline.catalog.stand_ins import FRAMES, SESSIONS, events_layout, frames, sessions
from spanline.operators.segment import refine_boundary
from spanline.plans import refine
from spanline.session import scratch_path
from spanline.timeunits import DAY, HOUR, ceil_to, floor_to

WEEK = 7 * DAY


@query(
    "w26_refine_stored",
    f"""with {FRAMES}, c as (select grp, ceil(min(t) / 86400000000.0)::bigint * 86400000000 as b,
   floor(max(t) / 86400000000.0)::bigint * 86400000000 as e from frames group by 1),
s as (select grp, t from frames where label in ('view', 'click')),
near as (select c.grp, min(t) filter (t between c.b - 86400000000 and c.b) as first,
   max(t) filter (t between c.e - 86400000000 and c.e + 86400000000) as last
 from c left join s on s.grp = c.grp group by 1)
select grp, coalesce(first, b) as b, coalesce(last + 3600000000, e) as e from c join near using (grp)""",
)
def refine_stored(spark, sf):
    """Days refined by samples that are read back from the folders near their bounds."""
    path = scratch_path(spark, "fine")
    ev = frames(spark, sf)
    refine.write_fine(
        ev.filter(F.col("label").isin("view", "click")).select("grp", "t"), path, "grp", WEEK
    )
    coarse = ev.groupBy("grp").agg(
        ceil_to(F.min("t"), DAY).alias("b"), floor_to(F.max("t"), DAY).alias("e")
    )
    near = refine.read_near(spark, path, coarse, "grp", WEEK, DAY)
    return refine_boundary(
        coarse, near, ["grp"], DAY, layout=events_layout(spark, sf), tail=HOUR
    )


@query("rounds_refined")
def rounds_refined(spark, sf):
    """The rounds of all recordings and their parts, bounds refined; a round's own row has no kind."""
    rounds, parts = rounds_and_parts(spark, sf)
    labels = recording_labels(spark, sf).filter(F.col("attr") == "game").select("grp", "t", "label")
    path = scratch_path(spark, "fine")
    refine.write_fine(labels, path, "grp", WEEK)
    begins = rounds.select("grp", "round", F.col("b").alias("rb"))
    bounds = rounds.select("grp", "b", "e").unionByName(
        parts.join(begins, ["grp", "round"]).select(
            "grp", (F.col("b") + F.col("rb")).alias("b"), (F.col("e") + F.col("rb")).alias("e")
        )
    )
    near = refine.read_near(spark, path, bounds, "grp", WEEK, 12 * HOUR)
    out, moved = refine.refine_rounds(
        rounds, parts, near, "grp", 12 * HOUR, HOUR, layout=events_layout(spark, sf)
    )
    names = ["grp", "round", "kind", "type", "b", "e"]
    own = [F.lit(None).cast("string").alias(c) for c in ("kind", "type")]
    return out.select("grp", "round", *own, "b", "e").unionByName(moved.select(*names))


TEAMS = [(1, "view"), (1, "click"), (1, "error"), (2, "purchase"), (2, "signup"), (2, "refund")]


@query(
    "round_players",
    f"""with recursive {FRAMES},{SESSIONS},
teams(team, name) as (values {', '.join(map(str, TEAMS))}),
windows as (select grp, sid, b + case when sid % 3 = 0 then 10800000000 else 0 end as begin from sessions),
seen as (select f.grp, w.sid, case when k % 2 = 0 then 'left' else 'right' end as side, (k % 3)::int as slot, f.t,
   case when k % 5 < 2 then label || 'x' else label end as name
 from frames f asof join windows w on f.grp = w.grp and f.t >= w.begin where f.t < w.begin + 172800000000),
per as (select grp, sid, side, slot, name, count(*) as votes, min(t) as t, name in (select name from teams) as known
   from seen group by all),
voted as (select * from per qualify row_number() over (partition by grp, sid, side, slot
   order by not known, case when known then 0 else -votes end, t, name) = 1),
sides as (select grp, sid, count(*) filter (side = 'left' and team = 1) > count(*) filter (side = 'left' and team = 2)
   as one_left from voted left join teams using (name) group by 1, 2),
placed as (select v.*, case when (side = 'left') = one_left then 1 else 2 end as team from voted v join sides using (grp, sid)),
rosters as (select team, list(name order by name) as roster from teams group by 1),
exact as (select p.*, roster, list_contains(roster, p.name) as exact from placed p join rosters using (team)),
todo as (select *, row_number() over (partition by grp, sid, side order by slot) as i from exact where not exact),
start as (select grp, sid, side, list_filter(any_value(roster),
   lambda r: not list_contains(coalesce(list(name) filter (exact), []), r)) as free from exact group by 1, 2, 3),
go as (select grp, sid, side, 0::bigint as i, null::varchar as pick, free from start
 union all
 select g.grp, g.sid, g.side, n.i, p.pick, list_filter(g.free, lambda r: r <> p.pick) from go g
 join todo n on n.grp = g.grp and n.sid = g.sid and n.side = g.side and n.i = g.i + 1,
 lateral (select list_min(list_transform(g.free, lambda r: {{'d': levenshtein(n.name, r), 'r': r}})).r as pick) p
 where len(g.free) > 0)
select e.grp, e.sid as round, e.side, e.slot, e.team, e.name, coalesce(g.pick, e.name) as player
from exact e left join todo using (grp, sid, side, slot)
left join go g on g.grp = e.grp and g.sid = e.sid and g.side = e.side and g.i = todo.i""",
)
def round_players(spark, sf):
    """Who stands in each slot of each session: labels as names, two in five read with a wrong letter."""
    f = frames(spark, sf)
    k = F.col("k")
    names = f.select(
        "grp", F.when(k % 2 == 0, "left").otherwise("right").alias("side"), (k % 3).alias("slot"), "t",
        F.when(k % 5 < 2, F.concat("label", F.lit("x"))).otherwise(F.col("label")).alias("name"),
    )
    rounds = sessions(spark, sf).select("grp", F.col("sid").alias("round"), "b", "e")
    parts = rounds.filter("round % 3 = 0").select(
        "grp", "round", F.lit("replay").alias("kind"), F.lit(None).cast("string").alias("type"),
        F.lit(0).cast("bigint").alias("b"), F.lit(2 * HOUR).alias("e"),
    )
    both = F.array(*[F.struct(F.lit(n).alias("team"), F.lit(name).alias("name")) for n, name in TEAMS])
    teams = f.select("grp").distinct().select("grp", F.inline(both))
    return refine.players_of_rounds(
        names, rounds, parts, teams, "grp", 5 * HOUR, HOUR, 2 * DAY, layout=events_layout(spark, sf)
    )
