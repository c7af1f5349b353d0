"""Temporal and key joins (JN-01 .. JN-23, FLT-06/07, W-22/26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import (
    FRAMES,
    GRP,
    IV,
    SESSIONS,
    events_layout,
    frames,
    iv,
    sessions,
    table,
)
from spanline.operators import joins as ops
from spanline.session import small_table
from spanline.timeunits import HOUR, micros

# Probe times: every event shifted by two hours, so that some fall into gaps.
PROBES = "probes as (select grp, event_id, t + 7200000000 as t from frames)"


def probes(spark, sf):
    return frames(spark, sf).select("grp", "event_id", (F.col("t") + 2 * HOUR).alias("t"))


@query(
    "jn01_state_at",
    f"""with {IV}, {PROBES}
select p.grp, p.event_id, p.t, i.status from probes p left join iv i
  on i.grp = p.grp and p.t between i.b and i.e
qualify row_number() over (partition by p.event_id order by i.b) = 1""",
)
def state_at(spark, sf):
    return ops.state_at(probes(spark, sf), iv(spark, sf), GRP, layout=events_layout(spark, sf))


@query(
    "jn02_has_state_at",
    f"""with {IV}, {PROBES}, c as (select p.*, case when f.k % 2 = 0 then 'view' else 'click' end as status
  from probes p join frames f using (event_id))
select grp, event_id, t, status from c where exists (select 1 from iv i where i.grp = c.grp
  and i.status = c.status and c.t between i.b and i.e)""",
)
def has_state_at(spark, sf):
    c = frames(spark, sf).select(
        "grp",
        "event_id",
        (F.col("t") + 2 * HOUR).alias("t"),
        F.when(F.col("k") % 2 == 0, "view").otherwise("click").alias("status"),
    )
    return ops.has_state_at(c, iv(spark, sf), GRP, layout=events_layout(spark, sf)).select(
        "grp", "event_id", "t", "status"
    )


@query(
    "jn03_asof_forward",
    f"""with {IV}, {PROBES}, l as (select grp, arg_max(status, b) as last from iv group by 1)
select p.grp, p.event_id, p.t, coalesce(i.status, l.last) as status
from probes p asof left join iv i on p.grp = i.grp and p.t < i.e join l on l.grp = p.grp""",
)
def asof_forward(spark, sf):
    return ops.asof_forward(
        probes(spark, sf), iv(spark, sf), GRP, layout=events_layout(spark, sf)
    )


@query(
    "jn04_interval_lookup_default",
    f"""with {IV}, {PROBES}, l as (select grp, arg_max(status, b) as last from iv group by 1),
h as (select p.grp, p.event_id, p.t, i.status as hit from probes p left join iv i
  on i.grp = p.grp and i.b <= p.t and p.t < i.e)
select h.grp, h.event_id, h.t, coalesce(hit, last) as or_last, coalesce(hit, 'n/a') as or_na
from h join l using (grp)""",
)
def interval_lookup_default(spark, sf):
    lay = events_layout(spark, sf)
    states = iv(spark, sf)
    one = ops.interval_lookup_default(
        probes(spark, sf), states, GRP, out="or_last", layout=lay
    )
    return ops.interval_lookup_default(one, states, GRP, "t", "n/a", "or_na", lay).select(
        "grp", "event_id", "t", "or_last", "or_na"
    )


@query(
    "jn05_label_grid",
    f"""with {IV}, attrs as (select *, case when status in ('click','view') then 'browse' else 'act' end
   as attr from iv where grp % 10 <> 3 or status <> 'error'),
g as (select grp, t from frames where label = 'purchase'),
l as (select grp, attr, arg_max(status, b) as last from attrs group by 1, 2),
a as (select g.grp, g.t, i.status from g asof left join (select * from attrs where attr = 'browse') i
   on g.grp = i.grp and g.t < i.e),
b as (select g.grp, g.t, i.status from g asof left join (select * from attrs where attr = 'act') i
   on g.grp = i.grp and g.t < i.e)
select a.grp, a.t, coalesce(a.status, la.last, 'none') as browse, coalesce(b.status, lb.last, 'n/a') as act
from a join b on a.grp = b.grp and a.t = b.t
left join l la on la.grp = a.grp and la.attr = 'browse'
left join l lb on lb.grp = a.grp and lb.attr = 'act'""",
)
def label_grid(spark, sf):
    states = (
        iv(spark, sf)
        .filter((F.col("grp") % 10 != 3) | (F.col("status") != "error"))
        .withColumn(
            "attr", F.when(F.col("status").isin("click", "view"), "browse").otherwise("act")
        )
    )
    grid = frames(spark, sf).filter(F.col("label") == "purchase").select("grp", "t")
    return ops.label_grid(
        grid, states, GRP, ["browse", "act"], defaults={"browse": "none"},
        layout=events_layout(spark, sf),
    )


NEAR = """deaths as (select grp, t, event_id from frames where label = 'purchase'),
feed as (select grp, t, event_id, k from frames where label = 'error'),
pairs as (select d.grp, d.t, d.event_id, f.t as ft, f.event_id as fid, f.k,
    abs(f.t - d.t) as dist from deaths d join feed f on d.grp = f.grp),
best as (select * from pairs where dist <= 50400000000
  qualify row_number() over (partition by event_id order by dist, ft, fid) = 1)"""


def _deaths(spark, sf):
    ev = frames(spark, sf)
    left = ev.filter(F.col("label") == "purchase").select("grp", "t", "event_id")
    right = ev.filter(F.col("label") == "error").select(
        "grp", "t", F.col("event_id").alias("fid"), "k"
    )
    return left, right


@query(
    "jn06_nearest_event",
    f"""with {FRAMES}, {NEAR}
select d.grp, d.t, d.event_id, best.fid, best.ft from deaths d left join best using (event_id)""",
)
def nearest_event(spark, sf):
    left, right = _deaths(spark, sf)
    df = ops.nearest_event(
        left, right, GRP, "t", 14 * HOUR, "fid", events_layout(spark, sf)
    )
    return df.select(
        "grp", "t", "event_id", F.col("match.fid").alias("fid"), F.col("match.t").alias("ft")
    )


@query(
    "jn07_nearest_or_default",
    f"""with {FRAMES}, {NEAR}
select d.grp, d.t, d.event_id, coalesce(cast(best.fid as varchar), 'n/a') as fid,
  coalesce(cast(best.k as varchar), 'none') as k, least(d.t, best.ft) as event_t,
  best.fid is not null as matched from deaths d left join best using (event_id)""",
)
def nearest_or_default(spark, sf):
    left, right = _deaths(spark, sf)
    return ops.nearest_or_default(
        left, right, GRP, "t", 14 * HOUR, {"fid": "n/a", "k": "none"}, "fid",
        events_layout(spark, sf),
    )


@query(
    "jn08_overlap_duration",
    f"""with {IV},{SESSIONS}, known as (select * from iv where status <> 'signup'),
r as (select grp, sid, b + 3600000000 as b, e from sessions where e - b > 7200000000),
a as (select r.grp, r.sid, k.status, sum(k.e - k.b) as dur from r join known k
   on k.grp = r.grp and k.b between r.b and r.e group by 1, 2, 3),
f as (select r.grp, r.sid, k.status, sum(k.e - k.b) as dur from r join known k
   on k.grp = r.grp and k.b < r.e and k.e > r.b
   where not exists (select 1 from a where a.grp = r.grp and a.sid = r.sid) group by 1, 2, 3)
select grp, sid, status, cast(dur as bigint) as dur from (select * from a union all select * from f)""",
)
def overlap_duration(spark, sf):
    r = (
        sessions(spark, sf)
        .filter(F.col("e") - F.col("b") > 2 * HOUR)
        .select("grp", "sid", (F.col("b") + HOUR).alias("b"), "e")
    )
    return ops.overlap_duration(
        iv(spark, sf), r, GRP, "sid", "signup", events_layout(spark, sf)
    ).drop("seen")


@query(
    "jn09_not_within",
    f"""with {IV}, outer_iv as (select grp, b - 3600000000 as b, e + 10800000000 as e from iv
   where status in ('error', 'purchase'))
select grp, b, e, status from iv where status in ('click', 'view') and not exists (
  select 1 from outer_iv o where o.grp = iv.grp and o.b <= iv.b and iv.e <= o.e)""",
)
def not_within(spark, sf):
    states = iv(spark, sf)
    outer = states.filter(F.col("status").isin("error", "purchase")).select(
        "grp", (F.col("b") - HOUR).alias("b"), (F.col("e") + 3 * HOUR).alias("e")
    )
    inner = states.filter(F.col("status").isin("click", "view"))
    return ops.not_within(inner, outer, GRP, events_layout(spark, sf))


QUARTERS = """quarters as (select date_trunc('quarter', o_orderdate)::date as q from orders group by 1),
versions as (select strftime(q, '%Y-%m-%d') as version, q as begin,
  lead(q) over (order by q) as "end" from quarters)"""


@query(
    "jn10_valid_at",
    f"""with {QUARTERS}
select o_orderkey, version, round(date_diff('day', begin, o_orderdate::date)::double
  / date_diff('day', begin, "end"), 6) as progress
from orders left join versions on o_orderdate::date >= begin and (o_orderdate::date < "end" or "end" is null)""",
)
def valid_at(spark, sf):
    from spanline.operators.segment import version_intervals

    orders = table(spark, sf, "orders")
    starts = orders.select(
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("begin")
    ).distinct()
    versions = version_intervals(starts, "begin").withColumn(
        "version", F.date_format("begin", "yyyy-MM-dd")
    )
    return ops.valid_at(orders, versions, "o_orderdate").select(
        "o_orderkey", "version", F.round("progress", 6).alias("progress")
    )


@query(
    "jn11_dim_join",
    """with names as (select s_nationkey as k, max(lower(s_name)) as n, 1 as src from supplier
   where s_nationkey % 3 = 0 group by 1
  union all select n_nationkey, lower(n_name), 0 from nation),
best as (select k, arg_max(n, src) as n from names group by 1)
select o_orderkey, c_nationkey as nationkey, n as name
from orders join customer on o_custkey = c_custkey left join best on k = c_nationkey""",
)
def dim_join(spark, sf):
    nations = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name")
    )
    later = table(spark, sf, "supplier").filter(F.col("s_nationkey") % 3 == 0).select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name")
    )
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nationkey")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(cust, "o_custkey")
    return ops.dim_join(orders, [nations, later], "nationkey", "name").select(
        "o_orderkey", "nationkey", "name"
    )


@query(
    "jn12_skip_processed",
    """select o_orderkey, o_custkey from orders where o_orderkey not in
  (select l_orderkey from lineitem where l_returnflag = 'R')""",
)
def skip_processed(spark, sf):
    done = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    return ops.skip_processed(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey"
    )


@query(
    "jn13_relaxed_match",
    """with l as (select p_partkey as id, p_brand as f1, p_type as f2, p_size as f3, p_name as f4,
   p_partkey % 7 = 0 as flag from part where p_partkey % 2 = 0),
r as (select p_partkey as ord, p_brand as f1, p_type as f2, p_size as f3, p_name as f4,
   p_partkey % 7 = 0 as flag from part where p_partkey % 2 = 1),
m as (select l.id, r.ord, case when l.f2 = r.f2 and l.f3 = r.f3 and l.f4 = r.f4 then 4
   when l.f2 = r.f2 and l.f3 = r.f3 then 3 when l.f2 = r.f2 then 2 else 1 end as n
   from l join r on l.f1 = r.f1 and l.flag = r.flag)
select l.id, m.ord as matched_ord, m.n as matched_fields from l left join m on l.id = m.id
qualify row_number() over (partition by l.id order by m.n desc, m.ord) = 1""",
)
def relaxed_match(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("f1"),
        F.col("p_type").alias("f2"),
        F.col("p_size").alias("f3"),
        F.col("p_name").alias("f4"),
        (F.col("p_partkey") % 7 == 0).alias("flag"),
    )
    left = part.filter(F.col("id") % 2 == 0)
    right = part.filter(F.col("id") % 2 == 1).withColumnRenamed("id", "ord")
    return ops.relaxed_match(
        left, right, ["f1", "f2", "f3", "f4"], [4, 3, 2, 1], "id", "ord", "flag"
    ).select("id", "matched_ord", "matched_fields")


CAUSE_RULES = [
    ("purchase", "enemy", "view", 0),
    ("purchase", "enemy", "click", 0),
    ("error", "friendly", "click", HOUR),
]


@query(
    "jn14_require_cause",
    f"""with {IV}, s as (select grp // 2 as round, case when grp % 2 = 0 then 'left' else 'right' end as side,
   b, e, status from iv),
rules as (select * from (values ('purchase','enemy','view',0), ('purchase','enemy','click',0),
   ('error','friendly','click',3600000000)) r(effect, relation, cause, lead_us)),
wide as (select round, side, status, b, e + 21600000000 as e from s)
select round, side, b, e, status from s where status not in ('purchase','error') or exists (
  select 1 from rules r join wide c on c.round = s.round
    and c.side = case when r.relation = 'friendly' then s.side
                      when s.side = 'left' then 'right' else 'left' end
    and c.status = r.cause and s.b - r.lead_us between c.b and c.e
  where r.effect = s.status)""",
)
def require_cause(spark, sf):
    s = iv(spark, sf).select(
        F.floor(F.col("grp") / 2).alias("round"),
        F.when(F.col("grp") % 2 == 0, "left").otherwise("right").alias("side"),
        "b", "e", "status",
    )
    rules = small_table(
        spark, CAUSE_RULES, "effect string, relation string, cause string, lead_us bigint"
    )
    causes = s.withColumn("e", F.col("e") + 6 * HOUR)
    return ops.require_cause(s, causes, rules, ["round"], layout=events_layout(spark, sf))


@query(
    "jn15_eligibility_mask",
    """with s as (select vec_id, label, list_transform(embedding, lambda x: x::double) as sc,
   label % 5 as grp, vec_id * 1000 as t from embeddings),
ok as (select *, exists (select 1 from orders where o_orderpriority = '1-URGENT'
     and o_custkey % 5 = s.grp and s.t between o_orderkey * 100 and o_orderkey * 100 + 300) as a,
   exists (select 1 from orders where o_orderpriority = '5-LOW'
     and o_custkey % 5 = s.grp and s.t between o_orderkey * 100 and o_orderkey * 100 + 300) as c from s),
m as (select vec_id, list_transform(sc, lambda x, i: case when i = 3 and not a then '-inf'::double
   when i in (5, 8) and not c then '-inf'::double else x end) as sc from ok)
select vec_id, cast(list_position(sc, list_max(sc)) - 1 as int) as best from m""",
)
def eligibility_mask(spark, sf):
    from spanline.functions.arrays import argmax_index

    s = table(spark, sf, "embeddings").select(
        "vec_id",
        (F.col("label") % 5).cast("bigint").alias("grp"),
        (F.col("vec_id") * 1000).alias("t"),
        F.col("embedding").alias("scores"),
    )
    ranges = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("name"),
        (F.col("o_custkey") % 5).cast("bigint").alias("grp"),
        (F.col("o_orderkey") * 100).alias("b"),
        (F.col("o_orderkey") * 100 + 300).alias("e"),
    )
    masked = ops.eligibility_mask(
        s, ranges, {2: "1-URGENT", 4: "5-LOW", 7: "5-LOW"}, GRP
    )
    return masked.select("vec_id", argmax_index("scores").alias("best"))


@query(
    "jn16_nearest_name",
    """with obs as (select c_custkey, lower(c_mktsegment) as name from customer),
d as (select distinct name from obs),
b as (select d.name, lower(n_name) as roster, levenshtein(d.name, lower(n_name)) as dist
      from d, nation qualify row_number() over (partition by d.name order by dist, roster) = 1)
select c_custkey, name, roster as best_name, cast(dist as int) as best_distance from obs join b using (name)""",
)
def nearest_name(spark, sf):
    obs = table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("name"))
    roster = table(spark, sf, "nation").select(F.lower("n_name").alias("rname"))
    return ops.nearest_name(obs, roster, "name", "rname")


@query(
    "jn16_fuzzy_assign",
    """with recursive names as (select n_regionkey as grp, c_custkey as slot, 'natio' || (c_custkey % 40)::varchar as name,
   row_number() over (partition by n_regionkey order by c_custkey) as i from customer join nation on c_nationkey = n_nationkey),
roster as (select n_regionkey as grp, list(lower(n_name) order by lower(n_name)) as free from nation group by 1),
go as (select grp, 0::bigint as i, null::varchar as pick, free from roster
  union all
  select g.grp, n.i, p.pick, list_filter(g.free, lambda r: r <> p.pick) from go g join names n on n.grp = g.grp and n.i = g.i + 1,
  lateral (select list_min(list_transform(g.free, lambda r: {'d': levenshtein(n.name, r), 'r': r})).r as pick) p
  where len(g.free) > 0)
select names.grp, slot, name, coalesce(pick, name) as assigned from names left join go on go.grp = names.grp and go.i = names.i""",
)
def fuzzy_assign(spark, sf):
    """Customers of a region, slot by slot, get the closest free nation name of it."""
    nation = table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_regionkey").alias("grp"), F.lower("n_name").alias("nation")
    )
    names = table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        "grp", F.col("c_custkey").alias("slot"),
        F.concat(F.lit("natio"), (F.col("c_custkey") % 40).cast("string")).alias("name"),
    )
    roster = nation.select("grp", F.col("nation").alias("name"))
    return ops.fuzzy_assign(names, roster, GRP)


@query(
    "jn17_lookahead_pending",
    f"""with {FRAMES}, p as (select grp, t, event_id from frames where label = 'view'),
bey as (select p.event_id as pid, p.t as pt, f.t, f.event_id from p join frames f on f.grp = p.grp
   and f.t > p.t and f.t <= p.t + 36000000000),
adm as (select e.pid, e.event_id from bey e where e.t <= e.pt + 14400000000 and not exists (
   select 1 from bey e2 where e2.pid = e.pid and e2.event_id <> e.event_id
     and e2.t - e.t <= 14400000000 and not exists (
       select 1 from bey e3 where e3.pid = e.pid and e3.event_id not in (e.event_id, e2.event_id)
         and e3.t - e2.t <= 14400000000)))
select p.grp, p.t, p.event_id, count(adm.event_id) as n_pending from p
left join adm on adm.pid = p.event_id group by 1, 2, 3""",
)
def lookahead_pending(spark, sf):
    ev = frames(spark, sf).select("grp", "t", "event_id", "label")
    points = ev.filter(F.col("label") == "view").drop("label")
    return ops.lookahead_pending(
        points, ev, GRP, "t", 4 * HOUR, 10 * HOUR, layout=events_layout(spark, sf)
    )


@query(
    "jn18_in_any_range",
    f"""with {FRAMES}, r as (select grp, t as b, t + k::bigint * 600000000 as e from frames
   where label = 'purchase')
select grp, t, event_id, label from frames f where exists (select 1 from r where r.grp = f.grp
   and f.t between r.b and r.e)""",
)
def in_any_range(spark, sf):
    ev = frames(spark, sf).select("grp", "t", "event_id", "label", "k")
    r = ev.filter(F.col("label") == "purchase").select(
        "grp", F.col("t").alias("b"),
        (F.col("t") + F.col("k").cast("bigint") * 600_000_000).alias("e"),
    )
    return ops.in_any_range(ev.drop("k"), r, GRP, layout=events_layout(spark, sf))


@query(
    "jn19_allowed_or",
    """with d as (select p_brand, list(distinct p_type) as allowed from part where p_size % 4 = 0 group by 1)
select p_partkey, p_brand, case when list_contains(allowed, p_type) then p_type else 'primary' end as p_type
from part left join d using (p_brand)""",
)
def allowed_or(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    dim = part.filter(F.col("p_size") % 4 == 0).groupBy("p_brand").agg(
        F.collect_set("p_type").alias("allowed")
    )
    return ops.allowed_or(
        part.drop("p_size"), dim, "p_brand", "p_type", "primary"
    ).select("p_partkey", "p_brand", "p_type")


@query(
    "jn20_next_event_after",
    f"""with {FRAMES}, c as (select grp, t, event_id from frames where label = 'click'),
p as (select * from frames where label = 'purchase'), x as (select * from frames where label = 'error')
select c.grp, c.t, c.event_id, p.t as next_buy, x.t as next_error, least(p.t, x.t) as next_any
from c asof left join p on c.grp = p.grp and c.t <= p.t
asof left join x on c.grp = x.grp and c.t <= x.t""",
)
def next_event_after(spark, sf):
    lay = events_layout(spark, sf)
    ev = frames(spark, sf).select("grp", "t", "event_id", "label")
    df = ev.filter(F.col("label") == "click").drop("label")
    df = ops.next_event_after(
        df, ev.filter(F.col("label") == "purchase"), GRP, "t", "next_buy", lay
    )
    df = ops.next_event_after(
        df, ev.filter(F.col("label") == "error"), GRP, "t", "next_error", lay
    )
    return df.withColumn("next_any", F.least("next_buy", "next_error"))


@query(
    "jn21_dense_pairs",
    """with v as (select distinct event_type as l from events) select a.l as cur, b.l as nxt from v a, v b""",
)
def dense_pairs(spark, sf):
    vocab = table(spark, sf, "events").select(F.col("event_type").alias("label"))
    return ops.dense_pairs(vocab, "label")


@query(
    "jn22_roster_fallback",
    """with own as (select n_nationkey as k, coalesce((select list(c_name order by c_name) from customer
   where c_nationkey = n_nationkey and c_acctbal > 9900), []) as r from nation),
fb as (select s_nationkey as k, list(s_name order by s_name) as r from supplier group by 1)
select k as nationkey, array_to_string(case when len(own.r) > 0 then own.r else fb.r end, ',') as roster,
  len(own.r) > 0 as full_data from own left join fb using (k)""",
)
def roster_fallback(spark, sf):
    rich = table(spark, sf, "customer").filter(F.col("c_acctbal") > 9900)
    own = (
        table(spark, sf, "nation")
        .select(F.col("n_nationkey").alias("nationkey"))
        .join(
            rich.groupBy(F.col("c_nationkey").alias("nationkey")).agg(
                F.array_sort(F.collect_set("c_name")).alias("roster")
            ),
            "nationkey",
            "left",
        )
    )
    fb = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(
        F.array_sort(F.collect_set("s_name")).alias("roster")
    )
    return ops.roster_fallback(own, fb, "nationkey").withColumn(
        "roster", F.array_join("roster", ",")
    )


@query(
    "jn23_missing_report",
    """select count(*) as n_missing, min(c_custkey) as first_missing, max(c_custkey) as last_missing
from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""",
)
def missing_report(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    done = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("id")
    )
    return ops.missing_report(cust, done, "id")


@query(
    "flt06_exclude_transition_zone",
    f"""with {IV}, z as (select * from iv where e - b >= 3600000000)
select f.grp, f.t, f.event_id, exists (select 1 from z where z.grp = f.grp
   and z.b + 1200000000 <= f.t and f.t < z.e - 1200000000) as inside
from frames f where not exists (select 1 from z where z.grp = f.grp and
   ((z.b <= f.t and f.t < z.b + 1200000000) or (z.e - 1200000000 <= f.t and f.t <= z.e)))""",
)
def exclude_transition_zone(spark, sf):
    zones = iv(spark, sf).filter(F.col("e") - F.col("b") >= HOUR)
    points = frames(spark, sf).select("grp", "t", "event_id")
    return ops.exclude_transition_zone(
        points, zones, GRP, HOUR // 3, layout=events_layout(spark, sf)
    )


@query(
    "flt07_exclude_boundary",
    f"""with {IV} select grp, t, event_id, label from frames f where not exists
 (select 1 from iv where iv.grp = f.grp and iv.b = f.t)""",
)
def exclude_boundary(spark, sf):
    points = frames(spark, sf).select("grp", "t", "event_id", "label")
    return ops.exclude_boundary(points, iv(spark, sf), GRP, layout=events_layout(spark, sf))


@query(
    "w22_attach_within",
    f"""with {IV},{SESSIONS}
select i.grp, s.sid, i.b - s.b as b, i.e - s.b as e, i.status from iv i join sessions s
  on s.grp = i.grp and i.b between s.b and s.e where i.status = 'error'""",
)
def attach_within(spark, sf):
    from spanline.operators.segment import attach_within as attach

    zooms = iv(spark, sf).filter(F.col("status") == "error")
    return attach(zooms, sessions(spark, sf), GRP, "sid", events_layout(spark, sf))


@query(
    "w26_refine_boundary",
    f"""with {FRAMES}, c as (select grp, ceil(min(t) / 86400000000.0)::bigint * 86400000000 as b,
   floor(max(t) / 86400000000.0)::bigint * 86400000000 as e from frames group by 1)
select c.grp, coalesce((select min(t) from frames f where f.grp = c.grp and f.label in ('view','click')
      and f.t >= c.b - 86400000000 and f.t <= c.b), c.b) as b,
  coalesce((select max(t) from frames f where f.grp = c.grp and f.label in ('view','click')
      and f.t >= c.e - 86400000000 and f.t <= c.e + 86400000000), c.e) as e from c""",
)
def refine_boundary(spark, sf):
    from spanline.operators.segment import refine_boundary as refine
    from spanline.timeunits import DAY, ceil_to, floor_to

    ev = frames(spark, sf)
    coarse = ev.groupBy("grp").agg(
        ceil_to(F.min("t"), DAY).alias("b"), floor_to(F.max("t"), DAY).alias("e")
    )
    fine = ev.filter(F.col("label").isin("view", "click")).select("grp", "t")
    return refine(coarse, fine, GRP, DAY, layout=events_layout(spark, sf))
