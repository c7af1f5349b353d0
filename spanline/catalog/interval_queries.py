"""Interval algebra and time grids (W-01 .. W-09, W-17, SRC-11/12, PRJ-09, FLT-04/10/11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import (
    FRAMES,
    GRP,
    IV,
    SESSIONS,
    coalesce_sql,
    events_layout,
    frames,
    iv,
    layout_for,
    min_duration_sql,
    sessions,
    table,
)
from spanline.operators import intervals as ops
from spanline.operators import votes
from spanline.session import small_table
from spanline.timeunits import DAY, HOUR, micros

RULES = {"click": 1 * HOUR, "view": 2 * HOUR, "error": 4 * HOUR, "purchase": 6 * HOUR}
RULES_SQL = (
    "case status when 'click' then 3600000000 when 'view' then 7200000000 "
    "when 'error' then 14400000000 when 'purchase' then 21600000000 end"
)


@query(
    "dominant_state",
    f"""with {IV},{min_duration_sql('iv', 'kept', RULES_SQL)},
per as (select grp, status, sum(e - b) as dur, min(b) as seen from kept group by 1, 2)
select grp, status, cast(dur as bigint) as dur from per
qualify row_number() over (partition by grp order by dur desc, seen) = 1""",
)
def dominant_state(spark, sf):
    """Flagship: events -> intervals -> short ones removed -> dominant state per user."""
    lay = events_layout(spark, sf)
    kept = ops.filter_min_duration(iv(spark, sf), GRP, RULES, layout=lay)
    return votes.duration_mode(kept, GRP)


@query("w01_run_length_encode", f"with {IV} select grp, b, e, status, n from iv")
def run_length_encode(spark, sf):
    return ops.run_length_encode(
        frames(spark, sf), GRP, "t", "label", ["event_id"], events_layout(spark, sf)
    )


LONG_ONLY = "pre as (select grp, b, e, status from iv where e - b >= 3600000000)"


@query(
    "w02_coalesce_intervals",
    f"with {IV},{LONG_ONLY},{coalesce_sql('pre', 'res')} select grp, b, e, status from res",
)
def coalesce_intervals(spark, sf):
    pre = iv(spark, sf).filter(F.col("e") - F.col("b") >= HOUR)
    return ops.coalesce_intervals(pre, GRP, layout=events_layout(spark, sf))


@query(
    "w02_coalesce_from_origin",
    f"""with {IV},{LONG_ONLY},{coalesce_sql('pre', 'res')}
select grp, case when row_number() over (partition by grp order by b) = 1 then 0 else b end as b,
       e, status from res""",
)
def coalesce_from_origin(spark, sf):
    pre = iv(spark, sf).filter(F.col("e") - F.col("b") >= HOUR)
    return ops.coalesce_intervals(pre, GRP, 0, events_layout(spark, sf))


@query(
    "w03_filter_min_duration",
    f"with {IV},{min_duration_sql('iv', 'res', RULES_SQL)} select grp, b, e, status from res",
)
def filter_min_duration(spark, sf):
    return ops.filter_min_duration(
        iv(spark, sf), GRP, RULES, layout=events_layout(spark, sf)
    )


@query(
    "w03_filter_one_threshold_protected",
    f"""with {IV},{min_duration_sql('iv', 'res', '7200000000', True)}
select grp, b, e, status from res""",
)
def filter_one_threshold(spark, sf):
    return ops.filter_min_duration(
        iv(spark, sf), GRP, 2 * HOUR, True, layout=events_layout(spark, sf)
    )


@query(
    "ud05_filter_by_rules_table",
    f"""with {IV}, rules as (select distinct label as status, k * 3600000000 as min_us from
  (select label, length(label) - 4 as k from frames where label <> 'signup')),
j as (select iv.grp, iv.b, iv.e, iv.status from iv),
{coalesce_sql('j', 'm').strip()},
k2 as (select m.grp, m.b, m.e, m.status from m left join rules using (status) qualify
   min_us is null or e - b >= min_us
   or row_number() over (partition by grp order by b desc, e desc) = 1),
{coalesce_sql('k2', 'res').strip()}
select grp, b, e, status from res""",
)
def filter_by_rules_table(spark, sf):
    rules = (
        frames(spark, sf)
        .filter(F.col("label") != "signup")
        .select(
            F.col("label").alias("status"),
            ((F.length("label") - 4) .cast("bigint") * HOUR).alias("min_us"),
        )
        .distinct()
    )
    return ops.filter_by_rules(iv(spark, sf), GRP, rules, layout=events_layout(spark, sf))


@query(
    "w04_anchor_smooth",
    f"""with {IV},
a as (select *, case when row_number() over w = 1
        or (e - b > 3600000000 and status <> 'error') then status end as anc
      from iv window w as (partition by grp order by b, e)),
f as (select *, last_value(anc ignore nulls) over (partition by grp order by b, e
        rows unbounded preceding) as cur from a),
pre as (select grp, b, e, status from f where status = cur),
{coalesce_sql('pre', 'res').strip()} select grp, b, e, status from res""",
)
def anchor_smooth(spark, sf):
    return ops.anchor_smooth(
        iv(spark, sf), GRP, HOUR, "error", layout=events_layout(spark, sf)
    )


@query(
    "w05_sandwich_relabel",
    f"""with {IV},
n as (select *, lag(status) over w as p, lead(status) over w as q
      from iv window w as (partition by grp order by b, e)),
r as (select grp, b, e, case
        when status <> 'view' and e = b and q <> 'view' then q
        when p = 'view' and status = 'click' and q = 'purchase' then 'purchase'
        else status end as status
      from n where not coalesce(status = 'error' and p = 'view' and q = 'view', false)),
{coalesce_sql('r', 'res').strip()} select grp, b, e, status from res""",
)
def sandwich_relabel(spark, sf):
    return ops.sandwich_relabel(
        iv(spark, sf),
        GRP,
        rewrites=[("view", "click", "purchase", "purchase")],
        normal="view",
        drops=[("error", "view")],
        layout=events_layout(spark, sf),
    )


@query(
    "w06_drop_early",
    f"""with {IV}, o as (select *, min(b) over (partition by grp) as s from iv)
select grp, b, e, status from o where status = 'view' or b - s >= 86400000000""",
)
def drop_early(spark, sf):
    return ops.drop_early(iv(spark, sf), GRP, DAY, "view")


@query(
    "w07_snap_begin",
    f"""with {IV}, p as (select *, lag(e) over (partition by grp order by b, e) as pe from iv)
select grp, case when b - pe < 36000000000 then pe + 1000000 else b end as b, e, status from p""",
)
def snap_begin(spark, sf):
    return ops.snap_begin(
        iv(spark, sf), GRP, 10 * HOUR, 1_000_000, events_layout(spark, sf)
    )


@query(
    "w08_union_intervals",
    f"""with {FRAMES},
x as (select grp, t - 21600000000 as b, t + k::bigint * 600000000 as e from frames),
m as (select *, max(e) over (partition by grp order by b, e
        rows between unbounded preceding and 1 preceding) as reach from x),
g as (select *, sum(case when b <= reach then 0 else 1 end) over (partition by grp order by b, e
        rows unbounded preceding) as i from m)
select grp, min(b) as b, max(e) as e from g group by grp, i""",
)
def union_intervals(spark, sf):
    x = frames(spark, sf).select(
        "grp",
        (F.col("t") - 6 * HOUR).alias("b"),
        (F.col("t") + F.col("k").cast("bigint") * 600_000_000).alias("e"),
    )
    return ops.union_intervals(x, GRP, events_layout(spark, sf))


@query(
    "w09_event_ranges",
    f"""with {FRAMES}, stop as (select max(t) as z from frames),
g as (select grp, t, sum(case when t - p <= 86400000000 then 0 else 1 end)
        over (partition by grp order by t rows unbounded preceding) as i
      from (select grp, t, lag(t) over (partition by grp order by t) as p
            from frames where label = 'purchase'))
select grp, min(t) as b, least(max(t) + 86400000000, 1705000000000000) as e
from g group by grp, i""",
)
def event_ranges(spark, sf):
    buys = frames(spark, sf).filter(F.col("label") == "purchase")
    return ops.event_ranges(
        buys, GRP, "t", DAY, 1_705_000_000_000_000, events_layout(spark, sf)
    )


@query(
    "w17_close_gaps",
    f"""with {IV},{LONG_ONLY},{coalesce_sql('pre', 'res')}
select grp, b, coalesce(lead(b) over (partition by grp order by b, e), e) as e, status
from res""",
)
def close_gaps(spark, sf):
    return ops.close_gaps(iv(spark, sf), GRP, HOUR, events_layout(spark, sf))


@query(
    "flt04_trim_sequences",
    f"""with {IV} select grp, b + 600000000 as b, e - 600000000 as e, status from iv
where e - 600000000 > b + 600000000""",
)
def trim_sequences(spark, sf):
    return ops.trim_sequences(iv(spark, sf), trim=600_000_000)


@query(
    "flt10_min_length",
    f"with {FRAMES},{SESSIONS} select grp, sid, b, e, n from sessions where e - b > 172800000000",
)
def min_length(spark, sf):
    return ops.min_length(sessions(spark, sf), 2 * DAY)


@query(
    "flt11_clip_window",
    f"""with {IV} select grp, b + 3600000000 as b, least(e, b + 10800000000) as e, status
from iv where e - b >= 10800000000
qualify row_number() over (partition by grp order by b, e) = 1""",
)
def clip_window(spark, sf):
    return ops.clip_window(iv(spark, sf), GRP, HOUR, 2 * HOUR)


@query(
    "prj09_rebase_time",
    f"""with {FRAMES},{SESSIONS}
select s.grp, s.sid, f.t - s.b as b, f.t - s.b + 1000000 as e
from numbered f join sessions s on s.grp = f.grp and s.sid = f.sid""",
)
def rebase_time(spark, sf):
    lay = events_layout(spark, sf)
    ev = ops.gap_sessions(frames(spark, sf), GRP, "t", 12 * HOUR, ["event_id"], lay)
    own = ev.select("grp", F.col("_session").alias("sid"), "t")
    df = own.join(sessions(spark, sf).select("grp", "sid", F.col("b").alias("pb")), ["grp", "sid"])
    df = df.select("grp", "sid", "pb", F.col("t").alias("b"), (F.col("t") + 1_000_000).alias("e"))
    return ops.rebase_time(df, "pb").drop("pb")


STEP_SQL = """steps as (select * from (values ('click', 3600000000), ('purchase', 1800000000))
  s(status, step_us))"""


@query(
    "src11_sampling_grid",
    f"""with {IV}, {STEP_SQL},
s as (select grp, b, e, coalesce(step_us, 7200000000) as st from iv left join steps using (status)
      union all
      select user_id, epoch_us(ts), epoch_us(ts) + 5400000000, 1800000000
      from events where event_type = 'error'),
p as (select grp, st, unnest(generate_series(b, e, st)) as t from s
      union select grp, st, e from s)
select distinct grp, t from p where not exists (
  select 1 from s where s.grp = p.grp and s.st < p.st and s.b <= p.t and p.t <= s.e)""",
)
def sampling_grid(spark, sf):
    steps = small_table(
        spark,
        [("click", HOUR), ("purchase", HOUR // 2), ("burst", HOUR // 2)],
        "status string, step_us bigint",
    )
    bursts = frames(spark, sf).filter(F.col("label") == "error").select(
        "grp", F.col("t").alias("b"), (F.col("t") + 5_400_000_000).alias("e"),
        F.lit("burst").alias("status"),
    )
    both = iv(spark, sf).select("grp", "b", "e", "status").unionByName(bursts)
    return ops.sampling_grid(both, GRP, steps, 2 * HOUR)


@query(
    "src12_uniform_grid",
    """with q as (select o_custkey as grp, min(epoch_us(o_orderdate)) + 86400000000 as b,
        max(epoch_us(o_orderdate)) - 86400000000 as e from orders group by 1),
g as (select grp, b, unnest(generate_series(0, (e - b) // 2592000000000)) as tick from q where e > b)
select grp, b + tick * 2592000000000 as t, tick from g where tick % 2 = 0""",
)
def uniform_grid(spark, sf):
    spans = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("grp"))
        .agg(F.min(micros("o_orderdate")).alias("b"), F.max(micros("o_orderdate")).alias("e"))
    )
    return ops.grid_for(ops.uniform_grid(spans, GRP, 30 * DAY, DAY), 2)


@query(
    "w32_chunk_sequences",
    f"""with {FRAMES}, r as (select *, row_number() over (partition by grp order by t, event_id) - 1
  as rn from frames)
select grp, cast(rn // 10 as bigint) as chunk, count(*) as n, min(t) as b, max(t) as e,
  string_agg(label, ',' order by t, event_id) as labels from r group by 1, 2""",
)
def chunk_sequences(spark, sf):
    df = ops.chunk_sequences(
        frames(spark, sf), GRP, ["t", "event_id"], 10, events_layout(spark, sf)
    )
    # a chunk holds at most ten rows, so the lists are bounded
    items = F.array_sort(F.collect_list(F.struct("t", "event_id", "label")))
    return df.groupBy("grp", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("b"),
        F.max("t").alias("e"),
        F.array_join(F.transform(items, lambda x: x["label"]), ",").alias("labels"),
    )


@query(
    "w33_near_boundary",
    f"""with {IV}, n as (select *, lag(status) over w as p, lead(status) over w as q
   from iv window w as (partition by grp order by b, e)),
a as (select grp, case when p = 'click' then b when q is null or q = 'click' then e end as edge
      from n where status = 'view')
select grp, edge - 3600000000 as b, edge + 3600000000 as e from a where edge is not null""",
)
def near_boundary(spark, sf):
    return ops.near_boundary(
        iv(spark, sf), GRP, HOUR, "view", "click", events_layout(spark, sf)
    )
