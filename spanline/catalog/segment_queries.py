"""Segmentation and derived timelines (W-14 .. W-34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import (
    FRAMES,
    GRP,
    IV,
    coalesce_sql,
    events_layout,
    frames,
    iv,
    layout_for,
    min_duration_sql,
    table,
)
from spanline.operators import derive as dv
from spanline.operators import segment as sg
from spanline.session import cut_lineage, small_table
from spanline.timeunits import DAY, HOUR, micros


def games(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("grp"),
        micros("o_orderdate").alias("t"),
        "o_orderkey",
        F.col("o_orderpriority").alias("map"),
        F.col("o_orderstatus").alias("result"),
        "o_totalprice",
    )


def games_layout(spark, sf):
    return layout_for(spark, sf, "orders", "o_custkey")


GAMES = """games as (select o_custkey as grp, epoch_us(o_orderdate) as t, o_orderkey,
   o_orderpriority as map, o_orderstatus as result, o_totalprice from orders)"""


@query(
    "w14_rising_only",
    f"""with {GAMES}, m as (select *, max(o_totalprice) over (partition by grp order by t, o_orderkey
   rows between unbounded preceding and 1 preceding) as top from games)
select grp, t, o_orderkey, round(o_totalprice, 2) as price from m where top is null or o_totalprice > top""",
)
def rising_only(spark, sf):
    df = dv.rising_only(
        games(spark, sf), GRP, ["t", "o_orderkey"], "o_totalprice", games_layout(spark, sf)
    )
    return df.select("grp", "t", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query(
    "w15_control_flips",
    f"""with {IV}, m as (select grp, b, case status when 'view' then 'Control_left' when 'click' then
   'Control_right' when 'error' then 'Control_neither' else 'Escort_1' end as s from iv)
select grp, b as t, case when s = 'Control_left' then 'L' else 'R' end as side from m
where s in ('Control_left', 'Control_right')""",
)
def control_flips(spark, sf):
    s = F.col("status")
    named = (
        F.when(s == "view", "Control_left")
        .when(s == "click", "Control_right")
        .when(s == "error", "Control_neither")
        .otherwise("Escort_1")
    )
    return dv.control_flips(iv(spark, sf).withColumn("status", named), GRP)


@query(
    "w16_overtime_spans",
    f"""with {IV},{min_duration_sql('iv', 'res', '7200000000')}
select grp, b, e + 1000000 as e, status from res where status = 'error'""",
)
def overtime_spans(spark, sf):
    return dv.overtime_spans(
        iv(spark, sf), GRP, "error", 2 * HOUR, 1_000_000, events_layout(spark, sf)
    )


@query(
    "w18_previous_value",
    f"""with {GAMES} select grp, o_orderkey, result,
  coalesce(lag(result) over (partition by grp order by t, o_orderkey), 'Start') as previous from games""",
)
def previous_value(spark, sf):
    return sg.previous_value(
        games(spark, sf), GRP, ["t", "o_orderkey"], "result", "Start",
        layout=games_layout(spark, sf),
    ).select("grp", "o_orderkey", "result", "previous")


@query(
    "w19_version_intervals",
    """with d as (select distinct o_orderdate::date as q from orders),
v as (select q, coalesce(lead(q) over (order by q), date '2002-01-01') as z from d)
select strftime(q, '%Y-%m-%d') as begin, strftime(z, '%Y-%m-%d') as "end",
  date_diff('day', q, z)::int as length_days from v""",
)
def version_intervals(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("begin")).distinct()
    return sg.version_intervals(d, "begin", "2002-01-01").select(
        F.date_format("begin", "yyyy-MM-dd").alias("begin"),
        F.date_format("end", "yyyy-MM-dd").alias("end"),
        "length_days",
    )


@query(
    "w20_relabel_pauses",
    f"""with {IV}, m0 as (select grp, b, e, case when status = 'signup' then 'click' else status end as status
   from iv),{coalesce_sql('m0', 'm')},
n as (select *, lag(status) over w as p, lead(status) over w as q, e - b as d
      from m window w as (partition by grp order by b, e)),
r as (select grp, b, e, case when status <> 'click' then status
   when d <= 14400000000 and d >= 1800000000 and p = 'view' and q = 'view' then 'off'
   when d <= 14400000000 and (p = 'error' or q = 'error') then 'error'
   when d > 14400000000 and p = 'error' then 'off' else status end as status from n),
{coalesce_sql('r', 'res').strip()} select grp, b, e, status from res""",
)
def relabel_pauses(spark, sf):
    merged = iv(spark, sf).withColumn(
        "status", F.when(F.col("status") == "signup", "click").otherwise(F.col("status"))
    )
    return sg.relabel_pauses(
        merged, GRP, 4 * HOUR, HOUR // 2, "view", "click", "error", "off",
        events_layout(spark, sf),
    )


ROUNDS_SQL = f"""with recursive {IV},
o as (select *, row_number() over w as rn, lag(e) over w as pe, lag(status) over w as ps
      from iv window w as (partition by grp order by b, e)),
st as (
  select grp, rn, case when status in ('view', 'purchase') then 'open' else 'none' end as state,
    case when status in ('view', 'purchase') then 1 else 0 end as round,
    case when status in ('view', 'purchase') then b end as rb,
    case when status in ('view', 'purchase') then e end as re from o where rn = 1
  union all
  select o.grp, o.rn,
    case when st.state = 'none' then case when o.status in ('view', 'purchase') then 'open' else 'none' end
         when o.status = 'view' then 'open'
         when st.state = 'paused' then 'paused'
         when o.status = 'error' then 'paused'
         when o.status = 'click' then 'none' else 'open' end,
    case when st.state = 'none' and o.status in ('view', 'purchase') then st.round + 1 else st.round end,
    case when st.state = 'none' and o.status = 'view' then o.b
         when st.state = 'none' and o.status = 'purchase' then case when o.ps = 'click' then o.pe else o.b end
         else st.rb end,
    case when st.state = 'none' and o.status in ('view', 'purchase') then o.e
         when st.state <> 'none' and o.status = 'view' then o.e else st.re end
  from st join o on o.grp = st.grp and o.rn = st.rn + 1),
rounds as (select grp, round::bigint as round, min(rb) as b, max(re) as e from st where state <> 'none' group by 1, 2)
select grp, round, b, e from rounds where e - b > 28800000000"""


PARTS_SQL = (
    ROUNDS_SQL.replace("select grp, round, b, e from rounds where e - b > 28800000000", "")
    + """, big as (select * from rounds where e - b > 28800000000),
x as (select o.*, st.round, st.state, lag(st.state) over (partition by o.grp order by o.rn) as before,
   lead(o.status) over (partition by o.grp order by o.rn) as ns, lead(o.b) over (partition by o.grp order by o.rn) as nb
   from o join st on st.grp = o.grp and st.rn = o.rn),
y as (select *, case when status = 'error' then 'Ingame pause' else 'Out of game pause' end as typ from x where state = 'paused'),
p as (select *, case when typ = 'Out of game pause' and lag(typ) over w = typ and lag(rn) over w = rn - 1
   then 0 else 1 end as f from y window w as (partition by grp order by rn)),
pieces as (select *, sum(f) over (partition by grp order by rn rows unbounded preceding) as piece from p),
parts as (
  select grp, round, 'pause' as kind, typ as type, min(b) as b, max(coalesce(nb, e)) as e from pieces group by grp, round, piece, typ
  union all select grp, round, 'smaller_window', null, b, e from x
    where status = 'purchase' and state = 'open' and (coalesce(before, 'none') = 'none' or ns = 'view')
  union all select grp, round, 'replay', null, b, e from x where status = 'signup' and state = 'open' and ns = 'view'),
rel as (select q.grp, q.round::bigint as round, kind, type, q.b - big.b as b, q.e - big.b as e
   from parts q join big on big.grp = q.grp and big.round = q.round)
"""
)


def _rounds(spark, sf):
    return sg.segment_rounds(
        iv(spark, sf), GRP, 8 * HOUR, "view", "click", "error", "signup", "purchase", "split",
        events_layout(spark, sf),
    )


@query("w21_segment_rounds", ROUNDS_SQL)
def segment_rounds(spark, sf):
    return _rounds(spark, sf)[0]


@query("w21_round_parts", PARTS_SQL + "select grp, round, kind, type, b, e from rel")
def round_parts(spark, sf):
    """Typed pauses, replays and small windows of every round."""
    return _rounds(spark, sf)[1]


@query(
    "w27_probe_start",
    PARTS_SQL
    + """select big.grp, big.round, coalesce((select e from rel where rel.grp = big.grp and rel.round = big.round
    and b < 18000000000 order by case kind when 'smaller_window' then 1 when 'replay' then 2 else 3 end, b, e limit 1)
  + 3600000000, 0)::bigint as start from big""",
)
def probe_start(spark, sf):
    rounds, parts = _rounds(spark, sf)
    return sg.probe_start(parts, rounds, GRP, 5 * HOUR, HOUR)


@query(
    "w23_forward_fill",
    f"""with {GAMES}, n as (select *, case when o_orderkey % 3 = 0 then map end as m,
   case when o_orderkey % 5 = 0 then result end as r from games)
select grp, o_orderkey, last_value(m ignore nulls) over w as m, last_value(r ignore nulls) over w as r
from n window w as (partition by grp order by t, o_orderkey rows unbounded preceding)""",
)
def forward_fill(spark, sf):
    n = games(spark, sf).select(
        "grp", "t", "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("map")).alias("m"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("result")).alias("r"),
    )
    return sg.forward_fill(
        n, GRP, ["t", "o_orderkey"], ["m", "r"], games_layout(spark, sf)
    ).drop("t")


@query(
    "w24_segment_games",
    f"""with {GAMES}, c as (select *, row_number() over w as rn,
   case when lag(result) over w is distinct from result then 1 else 0 end as f
   from games window w as (partition by grp order by t, o_orderkey)),
g as (select *, sum(f) over (partition by grp order by t, o_orderkey rows unbounded preceding)::bigint
   as game_number from c)
select grp, o_orderkey, result, game_number,
  row_number() over (partition by grp, game_number order by rn) as round_number from g""",
)
def segment_games(spark, sf):
    return sg.segment_games(
        games(spark, sf), GRP, ["t", "o_orderkey"], "result", games_layout(spark, sf)
    ).select("grp", "o_orderkey", "result", "game_number", "round_number")


@query(
    "w25_number_rows",
    f"""with {GAMES} select grp, o_orderkey, row_number() over (partition by grp order by t, o_orderkey) as n
from games""",
)
def number_rows(spark, sf):
    return sg.number_rows(
        games(spark, sf), GRP, ["t", "o_orderkey"], layout=games_layout(spark, sf)
    ).select("grp", "o_orderkey", "n")


# Two timelines of one group: even events tell "alive" (errors are deaths), all tell "hero".
ALIVE = """alive0 as (select grp, t, event_id, case when k < 40 then 'dead'
   else 'alive' end as label from frames),
alive_c as (select *, case when lag(label) over w is distinct from label then 1 else 0 end as f
   from alive0 window w as (partition by grp order by t, event_id)),
alive_g as (select *, sum(f) over (partition by grp order by t, event_id rows unbounded preceding) as g
   from alive_c),
alive as (select grp, min(t) as b, max(t) as e, any_value(label) as status from alive_g group by grp, g)"""


def alive_iv(spark, sf):
    from spanline.operators.intervals import run_length_encode

    f = frames(spark, sf).select(
        "grp", "t", "event_id",
        F.when(F.col("k") < 40, "dead").otherwise("alive").alias("label"),
    )
    return run_length_encode(
        f, GRP, "t", "label", ["event_id"], events_layout(spark, sf)
    ).drop("n")


@query(
    "w28_deaths",
    f"""with {IV}, {ALIVE}, d as (select grp, b as t from alive where status = 'dead')
select d.grp, d.t + 300000 as t, i.status as hero from d left join iv i
  on i.grp = d.grp and d.t between i.b and i.e""",
)
def deaths(spark, sf):
    return dv.deaths(
        alive_iv(spark, sf), iv(spark, sf), GRP, layout=events_layout(spark, sf)
    ).select("grp", "t", "hero")


@query(
    "w28_revives",
    f"""with {FRAMES}, {ALIVE}, n as (select *, lead(b) over (partition by grp order by b, e) as q from alive)
select grp, e as t from n where status = 'dead' and e - b <= 21600000000 and q is not null""",
)
def revives(spark, sf):
    return dv.revives(alive_iv(spark, sf), GRP, 6 * HOUR, layout=events_layout(spark, sf))


@query(
    "w29_switches",
    f"""with {IV}, {ALIVE}, s as (select *, lag(e) over (partition by grp order by b, e) as pe from iv),
k as (select grp, case when b - pe < 36000000000 then pe + 1000000 else b end as nb, b, e, status
   from s where not exists (select 1 from alive a where a.grp = s.grp and a.status = 'dead'
     and a.b <= s.b and s.e <= a.e)),
p as (select *, lag(status) over (partition by grp order by b, e) as ps from k)
select grp, nb as b, e, status as hero from p where status is distinct from ps""",
)
def switches(spark, sf):
    dead = alive_iv(spark, sf).filter(F.col("status") == "dead").select("grp", "b", "e")
    return dv.switches(
        iv(spark, sf), dead, GRP, 10 * HOUR, 1_000_000, events_layout(spark, sf)
    )


@query(
    "w30_lifecycle",
    f"""with {IV}, {ALIVE},
n as (select *, lag(status) over w as ps, lag(e) over w as pe, lead(status) over w as ns,
   lead(b) over w as nb, lead(e) over w as ne from iv window w as (partition by grp order by b, e)),
h as (select n.*, a1.status as h1, a2.status as h2 from n
   left join alive a1 on a1.grp = n.grp and n.e between a1.b and a1.e
   left join alive a2 on a2.grp = n.grp and n.e + 1800000000 between a2.b and a2.e),
x as (select *, case when ps = 'view' and b - pe < 10800000000 then pe + 1000000
      when status = 'purchase' then b - 1000000 else b end as gained,
   status = 'click' and ns = 'view' and coalesce(h1 = h2, false) as same,
   (select max(t) from frames s where s.label = 'signup' and s.grp = h.grp and s.t <= h.nb) as st
   from h where status = 'click' or (status = 'purchase' and ps = 'view'))
select grp, gained,
  case when status = 'click' and ns = 'purchase' then e + 1000000 when status = 'purchase' then b
       when same and nb - st < 14400000000 then nb - 14400000000
       when same and ne - nb > 3600000000 then e + 1000000 end as used,
  case when status = 'click' and ns = 'purchase' then ne + 1000000 when status = 'purchase' then e + 1000000
       when same and (nb - st < 14400000000 or ne - nb > 3600000000) then nb + 1000000 end as ended
from x""",
)
def lifecycle(spark, sf):
    starts = frames(spark, sf).filter(F.col("label") == "signup").select("grp", F.col("t").alias("b"))
    return dv.lifecycle(
        iv(spark, sf), GRP, ("view", "click", "purchase"), alive_iv(spark, sf), starts,
        max_gap=3 * HOUR, tick=1_000_000, same_hero_after=HOUR // 2, near_start=4 * HOUR,
        long_after=HOUR, layout=events_layout(spark, sf),
    )


@query(
    "w30_lifecycle_suppressed",
    f"""with {IV}, {ALIVE},
n as (select *, lag(status) over w as ps, lag(e) over w as pe, lead(status) over w as ns,
   lead(b) over w as nb, lead(e) over w as ne from iv window w as (partition by grp order by b, e)),
h as (select n.*, a1.status as h1, a2.status as h2 from n
   left join alive a1 on a1.grp = n.grp and n.e between a1.b and a1.e
   left join alive a2 on a2.grp = n.grp and n.e + 1800000000 between a2.b and a2.e),
x as (select *, case when ps = 'view' and b - pe < 10800000000 then pe + 1000000
      when status = 'purchase' then b - 1000000 else b end as gained,
   status = 'click' and ns = 'view' and coalesce(h1 = h2, false) and ne - nb > 3600000000 as unseen
   from h where status = 'click' or (status = 'purchase' and ps = 'view')),
u as (select grp, gained,
  case when status = 'click' and ns = 'purchase' then e + 1000000 when status = 'purchase' then b
       when unseen then e + 1000000 end as used,
  case when status = 'click' and ns = 'purchase' then ne + 1000000 when status = 'purchase' then e + 1000000
       when unseen then nb + 1000000 end as ended from x),
s as (select u.*, coalesce((select arg_min(status, b) from alive a where a.grp = u.grp
     and u.gained between a.b and a.e) = 'dead', false) as special,
   exists (select 1 from alive a where a.grp = u.grp and coalesce(u.used, u.gained) between a.b and a.e) as named,
   coalesce((select arg_min(status, b) from alive a where a.grp = u.grp
     and u.gained - 3600000000 between a.b and a.e) = 'alive', false) as living from u),
f as (select grp, unnest(list_reduce(list([{{'g': gained, 'u': used, 'd': ended, 's': special, 'n': named, 'l': living}}]
    order by gained), lambda k, x: case
      when x[1].s and x[1].u is not null and x[1].u - x[1].g < 43200000000 and not x[1].l then k
      when x[1].s and k[-1].d is not null and x[1].g - 43200000000 < k[-1].d then k
      when x[1].s and k[-1].u is null and x[1].u is not null and k[-1].s and x[1].n then list_concat(k[:-2],
        [{{'g': k[-1].g, 'u': x[1].u, 'd': x[1].d, 's': k[-1].s, 'n': k[-1].n, 'l': k[-1].l}}])
      else list_concat(k, x) end)) as r from s group by grp)
select grp, r.g as gained, r.u as used, r.d as ended from f""",
)
def lifecycle_suppressed(spark, sf):
    """Lifecycles with repeats of the special hero's charge dropped or merged."""
    lay = events_layout(spark, sf)
    # looked up five times: stored, so that no task encodes it for each anew
    alive = cut_lineage(alive_iv(spark, sf))
    base = dv.lifecycle(
        iv(spark, sf), GRP, ("view", "click", "purchase"), alive, None,
        max_gap=3 * HOUR, tick=1_000_000, same_hero_after=HOUR // 2, long_after=HOUR, layout=lay,
    )
    return dv.suppress_repeats(
        base, alive, alive, GRP, "dead", lay, quick=12 * HOUR, dead_before=HOUR
    )


@query(
    "w34_effects",
    f"""with {IV}, s as (select grp // 2 as round, case when grp % 2 = 0 then 'left' else 'right' end as side,
   grp as slot, b, e, status from iv),
p as (select *, lag(e) over (partition by slot order by b, e) as pe from s),
rules as (select * from (values ('purchase','enemy','view',0), ('purchase','enemy','click',0),
   ('error','friendly','click',3600000000)) r(effect, relation, cause, lead_us)),
wide as (select round, side, status, b, e + 21600000000 as e from s)
select round, side, slot, coalesce(pe + 1000000, b) as b,
  case when status = 'error' and e - b > 14400000000 then b + 14300000000 else e end + 1000000 as e, status
from p where status <> 'view' and (status not in ('purchase','error') or exists (
  select 1 from rules r join wide c on c.round = p.round
    and c.side = case when r.relation = 'friendly' then p.side
                      when p.side = 'left' then 'right' else 'left' end
    and c.status = r.cause and p.b - r.lead_us between c.b and c.e
  where r.effect = p.status))""",
)
def effects(spark, sf):
    from spanline.catalog.join_queries import CAUSE_RULES

    s = iv(spark, sf).select(
        F.floor(F.col("grp") / 2).alias("round"),
        F.when(F.col("grp") % 2 == 0, "left").otherwise("right").alias("side"),
        F.col("grp").alias("slot"),
        "b", "e", "status",
    )
    rules = small_table(
        spark, CAUSE_RULES, "effect string, relation string, cause string, lead_us bigint"
    )
    wide = s.withColumn("e", F.col("e") + 6 * HOUR)
    return dv.effects(
        s, wide, rules, ["round"], {"error": (4 * HOUR, 4 * HOUR - 100_000_000)}, 1_000_000,
        "view", events_layout(spark, sf),
    )


OWN_RULES = [
    ("purchase", "enemy", "view", 0),
    ("purchase", "own", "click", 2 * HOUR),
    ("error", "friendly", "click", HOUR),
]


@query(
    "w34_effects_own",
    f"""with {IV}, s as (select grp // 4 as round, case when grp % 2 = 0 then 'left' else 'right' end as side,
   grp as slot, b, e, status from iv),
p as (select *, lag(e) over (partition by slot order by b, e) as pe from s),
rules as (select * from (values ('purchase','enemy','view',0), ('purchase','own','click',7200000000),
   ('error','friendly','click',3600000000)) r(effect, relation, cause, lead_us)),
wide as (select round, side, slot, status, b, e + 3600000000 as e from s),
caused as (select * from p where status not in ('purchase','error') or exists (
  select 1 from rules r join wide c on c.round = p.round
    and case r.relation when 'own' then c.side = p.side and c.slot = p.slot
        when 'friendly' then c.side = p.side else c.side <> p.side end
    and c.status = r.cause and p.b - r.lead_us between c.b and c.e
  where r.effect = p.status))
select round, side, slot, coalesce(pe + 1000000, b) as b,
  case when status = 'error' and e - b > 14400000000 then b + 14300000000 else e end + 1000000 as e, status
from caused x where status <> 'view' and (status not in ('click','error') or exists (
  select 1 from wide c where c.round = x.round and c.slot = x.slot and c.status in ('view','purchase')
    and x.b - case x.status when 'click' then 0 else 1800000000 end between c.b and c.e))""",
)
def effects_own(spark, sf):
    """Effects of victims who lived, a cause among their own states included."""
    s = iv(spark, sf).select(
        F.floor(F.col("grp") / 4).alias("round"),
        F.when(F.col("grp") % 2 == 0, "left").otherwise("right").alias("side"),
        F.col("grp").alias("slot"),
        "b", "e", "status",
    )
    rules = small_table(
        spark, OWN_RULES, "effect string, relation string, cause string, lead_us bigint"
    )
    lived = small_table(spark, [("click", 0), ("error", HOUR // 2)], "effect string, lead_us bigint")
    wide = s.withColumn("e", F.col("e") + HOUR)
    return dv.effects(
        s, wide, rules, ["round"], {"error": (4 * HOUR, 4 * HOUR - 100_000_000)}, 1_000_000,
        "view", None, wide.filter(F.col("status").isin("view", "purchase")), lived,
    )


@query(
    "src12_day_grid_of_rounds",
    f"""with {FRAMES}, s as (select grp, min(t) as b, max(t) as e from frames group by 1),
g as (select grp, b + 600000000 as b, e - 600000000 as e from s where e - 600000000 > b + 600000000)
select grp, count(*) as n, max(t) as last_t from (
  select grp, b + unnest(generate_series(0, (e - b) // 86400000000)) * 86400000000 as t from g) group by 1""",
)
def day_grid(spark, sf):
    from spanline.operators.intervals import uniform_grid

    spans = frames(spark, sf).groupBy("grp").agg(F.min("t").alias("b"), F.max("t").alias("e"))
    return (
        uniform_grid(spans, GRP, DAY, 600_000_000)
        .groupBy("grp")
        .agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))
    )
