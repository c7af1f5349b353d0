"""Aggregations and evaluation (AG-01 .. AG-24)."""

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
    layout_for,
    sessions,
    table,
)
from spanline.operators import evaluate
from spanline.operators import votes as ops
from spanline.timeunits import HOUR, micros


@query(
    "ag01_duration_mode",
    f"""with {IV}, per as (select grp, status, sum(e - b)::bigint as dur, min(b) as seen from iv
   where status <> 'signup' group by 1, 2)
select grp, status, dur from per qualify row_number() over (partition by grp order by dur desc, seen) = 1""",
)
def duration_mode(spark, sf):
    return ops.duration_mode(iv(spark, sf), GRP, "signup")


@query(
    "ag02_majority_vote",
    f"""with {FRAMES}, f as (select grp, label, t, event_id, count(*) over (partition by grp, label) as votes,
   row_number() over (partition by grp, label order by t, event_id) as rn from frames)
select grp, label, votes from f where rn = 1
qualify row_number() over (partition by grp order by votes desc, t, event_id) = 1""",
)
def majority_vote(spark, sf):
    return ops.majority_vote(frames(spark, sf), GRP, "label", ["t", "event_id"])


@query(
    "ag03_roster_vote",
    """with f as (select l_suppkey as grp, p_brand as name, l_orderkey, l_linenumber
   from lineitem join part on l_partkey = p_partkey),
roster as (select p_brand as name from part group by 1 having max(p_size) >= 50),
c as (select grp, name, count(*) as votes, min((l_orderkey, l_linenumber)) as seen,
   bool_or(name in (select name from roster)) as in_roster from f group by 1, 2)
select grp, name, votes, in_roster from c qualify row_number() over (partition by grp
  order by in_roster desc, case when in_roster then 0 else -votes end, seen) = 1""",
)
def roster_vote(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    obs = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("grp"), F.col("p_brand").alias("name"), "l_orderkey", "l_linenumber"
    )
    roster = (
        part.groupBy(F.col("p_brand").alias("name"))
        .agg(F.max("p_size").alias("largest")).filter("largest >= 50").select("name")
    )
    return ops.roster_vote(obs, GRP, "name", roster, ["l_orderkey", "l_linenumber"])


@query(
    "ag04_side_vote",
    """select o_custkey as grp, count(*) filter (left_side and one)::bigint as left_one,
  count(*) filter (left_side and two)::bigint as left_two,
  count(*) filter (left_side and one) > count(*) filter (left_side and two) as team_one_left
from (select o_custkey, o_orderkey % 2 = 0 as left_side, o_orderpriority in ('1-URGENT','2-HIGH') as one,
  o_orderpriority in ('4-NOT SPECIFIED','5-LOW') as two from orders) group by 1""",
)
def side_vote(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("grp"),
        F.when(F.col("o_orderkey") % 2 == 0, "left").otherwise("right").alias("side"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("one"),
        F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW").alias("two"),
    )
    return ops.side_vote(df, GRP, "side", "one", "two")


@query(
    "ag05_play_time",
    f"""with {IV}, p as (select status, sum(e - b)::bigint as dur from iv group by 1),
r as (select *, row_number() over (order by dur) - 1 as i, count(*) over () as n from p)
select status, dur, (select dur from r where i = n // 2) as median,
  round((select dur from r where i = n // 2) / dur, 6) as ratio from r""",
)
def play_time(spark, sf):
    return ops.play_time(iv(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query(
    "ag06_share_of_total",
    """with p as (select l_suppkey as player, l_returnflag as map, p_brand as hero, sum(l_quantity) as qty
   from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)
select player, map, hero, round(qty, 2) as qty,
  round(qty / sum(qty) over (partition by player, map), 6) as share from p""",
)
def share_of_total(spark, sf):
    return (
        ops.share_of_total(pick_rows(spark, sf), ["player", "map"], "hero", "qty")
        .withColumn("qty", F.round("qty", 2))
        .withColumn("share", F.round("share", 6))
    )


def pick_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("player"),
        F.col("l_returnflag").alias("map"),
        F.col("p_brand").alias("hero"),
        F.col("l_quantity").alias("qty"),
    )


@query(
    "ag07_mean_with_zero_fill",
    """with p as (select l_suppkey as player, l_returnflag as map, p_brand as hero, l_quantity as qty
   from lineitem join part on l_partkey = p_partkey)
select hero, round(sum(qty) / (select count(*) from (select distinct player, map from p)), 6) as mean
from p group by 1""",
)
def mean_with_zero_fill(spark, sf):
    return ops.mean_with_zero_fill(
        pick_rows(spark, sf), ["player", "map"], "hero", "qty"
    ).withColumn("mean", F.round("mean", 6))


@query(
    "ag08_value_counts",
    """select col, value, count(*) as n from (
  select 'o_orderstatus' as col, o_orderstatus as value from orders union all
  select 'o_orderpriority', o_orderpriority from orders union all
  select 'o_custkey', cast(o_custkey as varchar) from orders) group by 1, 2""",
)
def value_counts(spark, sf):
    return ops.value_counts(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]
    )


@query(
    "ag09_bucket_rare",
    """with v as (select p_brand as v from part union all select p_type from part),
rare as (select v from v group by 1 having count(*) < 80)
select p_partkey, case when p_brand in (from rare) then 'unknown' else p_brand end as p_brand,
  case when p_type in (from rare) then 'unknown' else p_type end as p_type from part""",
)
def bucket_rare(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return ops.bucket_rare(part, ["p_brand", "p_type"], 80)


@query(
    "ag10_class_weights",
    """with v as (select distinct event_type as label from events union all select 'unseen'),
c as (select event_type as label, count(*) as n from events where value > 200 or event_type = 'view' group by 1)
select label, coalesce(n, 0) as n, round(case when n is null then 0.0
   else least((select sum(n) from c)::double / n, 1000.0) end, 6)::double as weight from v left join c using (label)""",
)
def class_weights(spark, sf):
    ev = frames(spark, sf)
    vocab = ev.select("label").distinct().unionByName(
        ev.agg(F.lit("unseen").alias("label"), F.count(F.lit(1)).alias("n")).select("label")
    )
    seen = ev.filter((F.col("value") > 200) | (F.col("label") == "view"))
    return ops.class_weights(seen, "label", vocab).withColumn("weight", F.round("weight", 6))


SEQS = "seqs as (select conv_id, list(role order by turn) as seq from conversations group by 1)"


def seqs(spark, sf):
    """Roles of a conversation in turn order."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    lay = layout_for(spark, sf, "conversations", "conv_id")
    return ops.ordered_arrays(turns, ["conv_id"], ["turn"], "role", "seq", lay).drop("part")


@query(
    "ag11_sequence_weights",
    f"""with {SEQS}, c as (select array_to_string(seq, ',') as seq, count(*) as n from seqs group by 1)
select seq, n, round(1 - n / (max(n) over ()), 6) as weight from c""",
)
def sequence_weights(spark, sf):
    return ops.sequence_weights(seqs(spark, sf), "seq").select(
        F.array_join("seq", ",").alias("seq"), "n", F.round("weight", 6).alias("weight")
    )


@query(
    "ag11_weigh_sequences",
    f"""with {SEQS}, c as (select array_to_string(seq, ',') as seq, count(*) as n from seqs group by 1),
w as (select seq, 1 - n / (max(n) over ()) as weight, n from c),
known as (select seq, weight from w where n > 1)
select array_to_string(s.seq, ',') as seq, round(coalesce(k.weight, 1), 6) as weight
from seqs s left join known k on k.seq = array_to_string(s.seq, ',')""",
)
def weigh_sequences(spark, sf):
    """Every sequence with its weight; those seen once are unknown to the table of weights."""
    each = seqs(spark, sf)
    weights = ops.sequence_weights(each, "seq").filter("n > 1")
    return ops.weigh_sequences(each, weights, "seq").select(
        F.array_join("seq", ",").alias("seq"), F.round("weight", 6).alias("weight")
    )


PREDS = """preds as (select d.doc_id, d.lang as attr, quality as truth, 1 - toxic as predicted,
   n_chars::bigint * 100000 as t from documents d join labels using (doc_id))"""


def preds(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        F.col("lang").alias("attr"),
        F.col("quality").alias("truth"),
        (1 - F.col("toxic")).alias("predicted"),
        (F.col("n_chars").cast("bigint") * 100_000).alias("t"),
    )


@query(
    "ag12_label_accuracy",
    f"""with {PREDS} select attr, truth, grouping(truth)::int as is_total,
  sum((truth = predicted)::int)::bigint as correct, count(*) as total,
  round(sum((truth = predicted)::int) / count(*), 6) as accuracy
from preds group by grouping sets ((attr, truth), (attr))""",
)
def label_accuracy(spark, sf):
    return evaluate.label_accuracy(preds(spark, sf), "attr", "truth", "predicted").withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query(
    "ag13_error_listing",
    f"""with {PREDS} select doc_id, attr, truth, predicted,
  printf('%02d_%02d.%d', t // 60000000, t // 1000000 % 60, t // 100000 % 10) as "at"
from preds where truth <> predicted""",
)
def error_listing(spark, sf):
    return evaluate.error_listing(
        preds(spark, sf), "truth", "predicted", "t", ["doc_id", "attr"]
    )


@query(
    "ag14_sequence_accuracy",
    f"""with {SEQS} select sum((seq = list_reverse(seq))::int)::bigint as correct, count(*) as total,
  round(sum((seq = list_reverse(seq))::int) / count(*), 6) as accuracy from seqs""",
)
def sequence_accuracy(spark, sf):
    df = seqs(spark, sf).withColumn("back", F.reverse("seq"))
    return evaluate.sequence_accuracy(df, "seq", "back").withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query(
    "ag16_weighted_mean",
    """select l_suppkey, round(coalesce(sum(l_extendedprice) filter (l_discount > 0.09)
   / nullif(sum(l_quantity) filter (l_discount > 0.09), 0), 0), 4) as mean
from lineitem group by 1""",
)
def weighted_mean(spark, sf):
    big = F.col("l_discount") > 0.09
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.sum(F.when(big, F.col("l_extendedprice"))).alias("s"),
            F.sum(F.when(big, F.col("l_quantity"))).alias("n"),
        )
        .select("l_suppkey", F.round(ops.weighted_mean(F.col("s"), F.col("n")), 4).alias("mean"))
    )


@query(
    "ag17_frame_budget",
    f"""with {FRAMES},{SESSIONS}, n as (select grp, (sum((e - b) // 600000000 + 1) * 12 * 3)::bigint as n_samples
  from sessions group by 1)
select grp, n_samples, floor(n_samples * 0.8)::bigint as n_train,
  (n_samples - floor(n_samples * 0.8))::bigint as n_val from n""",
)
def frame_budget(spark, sf):
    return ops.frame_budget(sessions(spark, sf), GRP, 600_000_000, 12, 3)


@query(
    "ag18_first_last",
    f"with {FRAMES} select grp, label, min(t) as first_t, max(t) as last_t from frames group by 1, 2",
)
def first_last(spark, sf):
    return ops.first_last(frames(spark, sf), ["grp", "label"], "t")


@query(
    "ag19_earliest_latest",
    f"""with {IV} select grp, min(b) as earliest, arg_max(e, b) as latest from iv
where status = 'purchase' group by 1""",
)
def earliest_latest(spark, sf):
    return ops.earliest_latest(iv(spark, sf), GRP, "purchase")


#: Every value of ``p_type``.
PART_TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]


@query(
    "ag20_pivot_wide",
    "select l_suppkey as player, "
    + ", ".join(f"round(sum(case when p_type = '{t}' then l_quantity else 0 end), 2) as \"{t}\"" for t in PART_TYPES)
    + " from lineitem join part on l_partkey = p_partkey group by 1",
)
def pivot_wide(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("player"), F.col("p_type").alias("hero"),
        F.col("l_quantity").alias("qty"),
    )
    wide = ops.pivot_wide(rows, ["player"], "hero", "qty", PART_TYPES)
    return wide.withColumns({h: F.round(h, 2) for h in PART_TYPES})


@query(
    "ag21_nest_rounds",
    """with d as (select l_orderkey, list((l_linenumber, l_partkey, l_quantity) order by l_linenumber, l_partkey, l_quantity) as doc
   from lineitem group by 1)
select l_orderkey, len(doc)::int as n_rounds, doc[1][2] as first_part, doc[-1][2] as last_part from d""",
)
def nest_rounds(spark, sf):
    docs = ops.nest_rounds(
        table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"],
        ["l_partkey", "l_quantity"], "doc", layout_for(spark, sf, "lineitem", "l_orderkey"),
    )
    return docs.select(
        "l_orderkey",
        F.size("doc").alias("n_rounds"),
        F.element_at("doc", 1)["l_partkey"].alias("first_part"),
        F.element_at("doc", -1)["l_partkey"].alias("last_part"),
    )


@query(
    "ag22_distinct_domain",
    """select distinct value from (select p_brand as value from part union all select p_type from part
  union all select cast(p_size as varchar) from part)""",
)
def distinct_domain(spark, sf):
    return ops.distinct_domain(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "ag22_char_domain",
    """select distinct value from (select unnest(string_split(s_name, '')) as value from supplier
  union all select unnest(string_split(n_name, '')) from nation) where value <> ''""",
)
def char_domain(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_name").alias("name")).unionByName(
        table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    )
    return ops.char_domain(names, "name")


@query(
    "ag23_transition_counts",
    f"""with {IV}, v as (select distinct status as s from iv),
n as (select *, lead(status) over (partition by grp order by b, e) as q,
   row_number() over (partition by grp order by b, e) as rn from iv),
x as (select status as cur, q as nxt, 1.0::double as x from n where q is not null
      union all select status, status, (e - b) / 3600000000.0 from n),
w as (select a.s as cur, b.s as nxt, 5 + coalesce((select sum(x) from x where cur = a.s and nxt = b.s), 0)
   as weight from v a, v b),
i as (select s, 1 + (select count(*) from n where rn = 1 and status = s) as c from v)
select cur, nxt, round(weight, 4) as weight, round(weight / sum(weight) over (partition by cur), 6) as p,
  round(c / (select sum(c) from i), 6) as init from w join i on i.s = w.cur""",
)
def transition_counts(spark, sf):
    states = iv(spark, sf)
    vocab = table(spark, sf, "events").select(F.col("event_type").alias("status"))
    out = ops.transition_counts(
        states, GRP, vocab, duration_unit=HOUR, layout=events_layout(spark, sf)
    )
    return out.select(
        "cur", "nxt", F.round("weight", 4).alias("weight"), F.round("p", 6).alias("p"),
        F.round("init", 6).alias("init"),
    )


@query(
    "ag24_dedup_by_key",
    """select o_custkey, o_orderpriority, o_orderkey, round(o_totalprice, 2) as o_totalprice from orders
qualify row_number() over (partition by o_custkey, o_orderpriority order by epoch_us(o_orderdate), o_orderkey) = 1""",
)
def dedup_by_key(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice",
        micros("o_orderdate").alias("t"),
    )
    return ops.dedup_by_key(
        orders, ["o_custkey", "o_orderpriority"], ["t", "o_orderkey"]
    ).drop("t").withColumn("o_totalprice", F.round("o_totalprice", 2))
