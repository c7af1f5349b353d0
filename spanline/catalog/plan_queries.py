"""The end-to-end jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.event_queries import abilities, observations
from spanline.catalog.registry import query
from spanline.catalog.stand_ins import (
    FRAMES,
    IV,
    events_layout,
    frames,
    iv,
    min_duration_sql,
    sessions,
    table,
)
from spanline.catalog.vote_queries import pick_rows
from spanline.plans import annotate, matches, rounds, samples
from spanline.session import small_table
from spanline.timeunits import HOUR

GAME = {
    "click": "not_game", "view": "game", "error": "pause", "purchase": "smaller_window",
    "signup": "replay",
}


def recording_labels(spark, sf):
    f = frames(spark, sf)
    game = F.lit(None).cast("string")
    for label, state in GAME.items():
        game = F.when(F.col("label") == label, state).otherwise(game)
    maps = F.concat(F.lit("map"), F.floor(F.col("k") / 25).cast("string"))
    side = F.when(F.col("k") % 2 == 0, "left").otherwise("right")
    per = F.array(
        F.struct(F.lit("game").alias("attr"), game.alias("label")),
        F.struct(F.lit("map").alias("attr"), maps.alias("label")),
        F.struct(F.lit("attacking_side").alias("attr"), side.alias("label")),
    )
    return f.select("grp", "t", "event_id", F.explode(per).alias("p")).select(
        "grp", "t", "event_id", "p.attr", "p.label"
    )


def rounds_and_parts(spark, sf):
    return rounds.rounds_of_recordings(
        recording_labels(spark, sf), "grp", rounds.RoundRules().scaled(240), ("event_id",),
        events_layout(spark, sf),
    )


@query("rounds_of_recordings")
def rounds_of_recordings(spark, sf):
    return rounds_and_parts(spark, sf)[0]


@query("match_documents")
def match_documents(spark, sf):
    docs = rounds.match_documents(rounds_and_parts(spark, sf)[0], "grp")
    return docs.select("grp", "game_number", "part", F.to_json("rounds").alias("rounds"))


def player_labels(spark, sf):
    f = frames(spark, sf)
    alive = F.when(F.col("label").isin("error", "signup"), "dead").otherwise("alive")
    charge = (
        F.when(F.col("k") % 3 == 0, "no_ult").when(F.col("k") % 3 == 1, "has_ult").otherwise("using_ult")
    )
    per = F.array(
        F.struct(F.lit("hero").alias("attr"), F.col("label").alias("label")),
        F.struct(F.lit("alive").alias("attr"), alive.alias("label")),
        F.struct(F.lit("charge").alias("attr"), charge.alias("label")),
    )
    return f.select(
        F.floor(F.col("grp") / 2).alias("round"),
        F.when(F.col("grp") % 2 == 0, "left").otherwise("right").alias("side"),
        F.col("grp").alias("slot"), "t", "event_id", F.explode(per).alias("p"),
    ).select("round", "side", "slot", "t", "event_id", "p.attr", "p.label")


def _annotated(spark, sf, lines=None):
    npcs = small_table(spark, [("turret", "click")], "npc string, hero string")
    labels = player_labels(spark, sf)
    ends = labels.groupBy("round").agg(F.max("t").alias("end"))
    return annotate.annotate_rounds(
        labels, observations(spark, sf), abilities(spark), npcs, ["turret"],
        annotate.PlayerRules().scaled(7200), ("event_id",), "error", events_layout(spark, sf),
        ends, (["signup"], ["primary", "melee"]), lines,
    )


@query("annotated_rounds")
def annotated_rounds(spark, sf):
    return _annotated(spark, sf)


@query("round_documents")
def round_documents(spark, sf):
    return annotate.round_documents(_annotated(spark, sf)).select(
        "round", "part", F.to_json("events").alias("events")
    )


def _encoded_sql(label: str, out: str) -> str:
    """Intervals of ``label`` (a SQL expression over ``rf``) per round, in CTE ``out`` as (grp, b, e, status)."""
    return f"""
{out}_l as (select grp, t, event_id, {label} as label from rf),
{out}_c as (select *, case when lag(label) over (partition by grp order by t, event_id)
   is distinct from label then 1 else 0 end as f from {out}_l),
{out}_i as (select *, sum(f) over (partition by grp order by t, event_id rows unbounded preceding) as i from {out}_c),
{out} as (select grp, min(t) as b, max(t) as e, any_value(label) as status from {out}_i group by grp, i)"""


POINT_STATUS = """case when k % 10 = 0 then 'Escort_2' else
  case (t // 86400000000) % 6 when 0 then 'Control_left' when 1 then 'Control_neither'
  when 2 then 'Control_right' when 3 then 'Assault_2' when 4 then 'Escort_3' else 'Assault_1' end end"""
OVERTIME = "case when label = 'error' or (t // 86400000000) % 3 = 0 then 'overtime' else 'none' end"


@query(
    "round_properties",
    f"""with {FRAMES}, rf as (select grp // 2 as grp, t, event_id, k, label from frames),
{_encoded_sql(POINT_STATUS, 'ps')},{min_duration_sql('ps', 'points', '7200000000')},
{_encoded_sql(OVERTIME, 'ot')},{min_duration_sql('ot', 'over', '7200000000')},
totals as (select grp, b, split_part(status, '_', 2)::bigint - 1
     + case when status like 'Assault%' then 2 else 3 end
       * (case when grp % 3 = 0 then 0 else (grp % 5) // 2 end) as total
   from points where status not like 'Control%' and split_part(status, '_', 2)::bigint > 1),
gains as (select *, max(total) over (partition by grp order by b, total
   rows between unbounded preceding and 1 preceding) as top from totals),
rows_of as (select grp, b, 'flip' as kind, case when status = 'Control_left' then 'L' else 'R' end as detail
   from points where status in ('Control_left', 'Control_right')
 union all select grp, b, 'gain', total::varchar from gains where top is null or total > top
 union all select grp, b, 'overtime', (e + 1000000)::varchar from over where status = 'overtime')
select grp as round, b as t, kind, detail from rows_of""",
)
def round_properties(spark, sf):
    """Flips, gains above all before them, and overtimes of every round."""
    f = frames(spark, sf).withColumn("round", F.floor(F.col("grp") / 2))
    day = F.floor(F.col("t") / (24 * HOUR))
    point = F.when(F.col("k") % 10 == 0, "Escort_2")
    names = ["Control_left", "Control_neither", "Control_right", "Assault_2", "Escort_3"]
    for n, name in enumerate(names):
        point = point.when(day % 6 == n, name)
    over = F.when((F.col("label") == "error") | (day % 3 == 0), "overtime").otherwise("none")
    per = F.array(
        F.struct(F.lit("point_status").alias("attr"), point.otherwise("Assault_1").alias("label")),
        F.struct(F.lit("overtime").alias("attr"), over.alias("label")),
    )
    labels = f.select("round", "t", "event_id", F.explode(per).alias("p")).select(
        "round", "t", "event_id", "p.attr", "p.label"
    )
    numbers = (
        f.select("round").distinct().filter("round % 3 <> 0")
        .withColumn("round_number", F.col("round") % 5 + 1)
    )
    return annotate.round_properties(labels, numbers, 2 * HOUR, 1_000_000, ("event_id",)).select(
        "round", "t", "kind", "detail"
    )


EFFECT_LABELS = {"click": "asleep", "error": "hacked", "purchase": "stunned"}


@query("round_states")
def round_states(spark, sf):
    """The events of all rounds with status effects, flips, gains and overtimes among them."""
    status = F.lit("normal")
    for label, effect in EFFECT_LABELS.items():
        status = F.when(F.col("label") == label, effect).otherwise(status)
    heroes = player_labels(spark, sf)
    states = heroes.filter(F.col("attr") == "hero").withColumn("attr", F.lit("status"))
    labels = heroes.unionByName(states.withColumn("label", status))
    causes = small_table(
        spark,
        [("asleep", "enemy", "view", 0), ("hacked", "enemy", "click", 0), ("stunned", "own", "purchase", 0)],
        "effect string, relation string, cause string, lead_us bigint",
    )
    living = small_table(spark, [("asleep", HOUR)], "effect string, lead_us bigint")
    rules, order, lay = annotate.PlayerRules().scaled(7200), ("event_id",), events_layout(spark, sf)
    lines = annotate.clean_timelines(labels, rules, order, lay)
    effects = annotate.player_effects(
        labels, causes, {"hacked": (4 * HOUR, 3 * HOUR)}, living, rules, order, "normal", lay, lines
    )
    properties = round_properties(spark, sf).select(
        "round", "t", "kind", F.lit(None).cast("string").alias("side"),
        F.lit(None).cast("bigint").alias("slot"), F.lit(None).cast("string").alias("who"), "detail",
    )
    return _annotated(spark, sf, lines).unionByName(effects).unionByName(properties)


@query(
    "samples_from_truth",
    f"""with {IV}, seqs as (select grp, min(t) as b, max(t) as e from frames group by 1),
truth as (select *, case when status in ('click', 'view') then 'browse' else 'act' end as attr from iv),
g as (select grp, b + 600000000 + unnest(generate_series(0, (e - b - 1200000000) // 3600000000)) * 3600000000 as t
   from seqs where e - b > 1200000000),
k as (select * from g where not exists (select 1 from truth x where x.grp = g.grp and x.b = g.t)),
l as (select grp, attr, arg_max(status, b) as last from truth group by 1, 2),
a as (select k.grp, k.t, i.status from k asof left join (select * from truth where attr = 'browse') i
   on k.grp = i.grp and k.t < i.e),
c as (select k.grp, k.t, i.status from k asof left join (select * from truth where attr = 'act') i
   on k.grp = i.grp and k.t < i.e)
select a.grp, a.t, coalesce(a.status, la.last, 'n/a') as browse, coalesce(c.status, lc.last, 'n/a') as act
from a join c on a.grp = c.grp and a.t = c.t
left join l la on la.grp = a.grp and la.attr = 'browse'
left join l lc on lc.grp = a.grp and lc.attr = 'act'""",
)
def samples_from_truth(spark, sf):
    truth = iv(spark, sf).withColumn(
        "attr", F.when(F.col("status").isin("click", "view"), "browse").otherwise("act")
    )
    spans = frames(spark, sf).groupBy("grp").agg(F.min("t").alias("b"), F.max("t").alias("e"))
    return samples.samples_from_truth(
        spans, truth, "grp", ["browse", "act"], HOUR, trim_us=600_000_000
    ).drop("split")


@query(
    "samples_dense_and_split",
)
def samples_dense_and_split(spark, sf):
    """The same with dense ranges around errors, masking and the train / validation split."""
    truth = iv(spark, sf).withColumn(
        "attr", F.when(F.col("status").isin("click", "view"), "browse").otherwise("act")
    )
    dense = iv(spark, sf).filter(F.col("status") == "error").select("grp", "b", "e")
    return samples.samples_from_truth(
        sessions(spark, sf).select("grp", "b", "e"), truth, "grp", ["browse", "act"], HOUR // 2,
        dense, 4, "browse", seed=1234, trim_us=60_000_000,
    )


@query(
    "match_table",
    """with quarters as (select date_trunc('quarter', o_orderdate)::date as q from orders group by 1),
versions as (select strftime(q, '%Y-%m-%d') as version, q as begin, lead(q) over (order by q) as z from quarters),
m as (select o_orderkey, o_custkey % 50 as league, o_orderdate::date as d, 'T' || (o_custkey % 20)::varchar as a,
   'T' || (o_orderkey % 20)::varchar as b, case o_orderstatus when 'F' then 'Team1wins' when 'O' then 'Team2wins'
   else 'Draw' end as r, 'p' || (o_custkey % 211)::varchar as p1, 'p' || (o_orderkey % 307)::varchar as p2 from orders),
f as (select o_orderkey, league, d, least(a, b) as team1, greatest(a, b) as team2,
   case when a > b and r = 'Team1wins' then 'Team2wins' when a > b and r = 'Team2wins' then 'Team1wins' else r end as result,
   case when a > b then p2 else p1 end as player1, case when a > b then p1 else p2 end as player2 from m),
n as (select p from (select player1 as p from f union all select player2 from f) group by 1 having count(*) < 90)
select o_orderkey, team1, team2, result,
  coalesce(lag(result) over (partition by league order by d, o_orderkey), 'Start') as previous_result,
  case when player1 in (from n) then 'unknown_player' else player1 end as player1,
  case when player2 in (from n) then 'unknown_player' else player2 end as player2,
  version, round(date_diff('day', begin, d)::double / date_diff('day', begin, z), 6) as progress
from f left join versions on d >= begin and (d < z or z is null)""",
)
def match_table(spark, sf):
    from spanline.operators.segment import version_intervals

    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def tag(prefix, n):
        return F.concat(F.lit(prefix), n.cast("string"))

    rows = o.select(
        "o_orderkey", (c % 50).alias("league"), F.col("o_orderdate").cast("date").alias("date"),
        tag("T", c % 20).alias("team1"), tag("T", k % 20).alias("team2"),
        F.when(F.col("o_orderstatus") == "F", "Team1wins")
        .when(F.col("o_orderstatus") == "O", "Team2wins").otherwise("Draw").alias("result"),
        tag("p", c % 211).alias("player1"), tag("p", k % 307).alias("player2"),
    )
    starts = o.select(F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("begin")).distinct()
    versions = version_intervals(starts, "begin").withColumn(
        "version", F.date_format("begin", "yyyy-MM-dd")
    )
    out = matches.match_table(
        rows, versions, ["league"], ["date", "o_orderkey"], ["player1", "player2"], 90
    )
    return out.select(
        "o_orderkey", "team1", "team2", "result", "previous_result", "player1", "player2", "version",
        F.round("progress", 6).alias("progress"),
    )


#: Every value of ``p_brand``.
BRANDS = [f"Brand#{k}" for k in range(1, 26)]


@query(
    "pick_table",
    """with p as (select l_suppkey as player, l_returnflag as map, p_brand as hero, sum(l_quantity) as qty
   from lineitem join part on l_partkey = p_partkey group by 1, 2, 3),
s as (select player, map, hero, qty / sum(qty) over (partition by player, map) as share from p)
select player, map, """
    + ", ".join(f"round(coalesce(sum(share) filter (hero = '{b}'), 0), 6)::double as \"{b}\"" for b in BRANDS)
    + " from s group by 1, 2",
)
def pick_table(spark, sf):
    rows = pick_rows(spark, sf).withColumnRenamed("qty", "time")
    wide = matches.pick_table(rows, BRANDS)
    return wide.select(
        "player", "map", *[F.round(F.col(f"`{b}`"), 6).alias(b) for b in BRANDS]
    )

