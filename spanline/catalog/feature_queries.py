"""Training sets, models and extension points (ML-*, UD-*)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import (
    FRAMES,
    GRP,
    IV,
    events_layout,
    frames,
    iv,
    layout_for,
    table,
)
from spanline.operators import features as ft
from spanline.timeunits import HOUR, micros


@query(
    "ml01_split_sizes",
    f"""with {FRAMES} select grp, count(*) as n, floor(count(*) * 0.8)::bigint as n_train,
  (count(*) - floor(count(*) * 0.8))::bigint as n_val from frames group by 1""",
)
def split_sizes(spark, sf):
    df = ft.split_train_val(
        frames(spark, sf).select("grp", "event_id"), GRP, "event_id", 0.8, 1234,
        events_layout(spark, sf),
    )
    return df.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("split") == "train").cast("bigint")).alias("n_train"),
        F.sum((F.col("split") == "val").cast("bigint")).alias("n_val"),
    )


@query(
    "ml01_split_train_val",
    f"""with {FRAMES} select grp, event_id, case when row_number() over (partition by grp
   order by md5(event_id || '|1234'), event_id) <= floor(count(*) over (partition by grp) * 0.8)
   then 'train' else 'val' end as split from frames""",
)
def split_train_val(spark, sf):
    return ft.split_train_val(
        frames(spark, sf).select("grp", "event_id"), GRP, "event_id", 0.8, 1234,
        events_layout(spark, sf),
    )


@query(
    "ml02_jitter_counts",
    "select doc_id, 5::bigint as n, 5::bigint as n_distinct, true as inside from documents",
)
def jitter_counts(spark, sf):
    df = ft.jitter_variants(table(spark, sf, "documents").select("doc_id"), "doc_id", 5, 4, 7)
    return df.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("dx", "dy").alias("n_distinct"),
        (F.max(F.greatest(F.abs("dx"), F.abs("dy"))) <= 4).alias("inside"),
    )


@query(
    "ml02_jitter_variants",
    """with o as (select x as dx, y as dy from (select unnest(range(-4, 5))::int as x), (select unnest(range(-4, 5))::int as y))
select doc_id, dx, dy from documents, o
qualify row_number() over (partition by doc_id order by md5(doc_id || '|' || dx || '|' || dy || '|7'), dx, dy) <= 5""",
)
def jitter_variants(spark, sf):
    return ft.jitter_variants(table(spark, sf, "documents").select("doc_id"), "doc_id", 5, 4, 7)


@query(
    "ml03_adaptive_sample",
    f"""with {IV}, g as (select grp, b + tick * 3600000000 as t, tick from (select grp, min(t) as b,
   unnest(generate_series(0, (max(t) - min(t)) // 3600000000)) as tick from frames group by grp))
select distinct grp, t, tick from g where tick % 4 = 0 or exists (select 1 from iv where iv.grp = g.grp
  and status = 'error' and g.t between iv.b - 3600000000 and iv.e + 3600000000)""",
)
def adaptive_sample(spark, sf):
    from spanline.operators.intervals import uniform_grid

    spans = frames(spark, sf).groupBy("grp").agg(F.min("t").alias("b"), (F.max("t") + 1).alias("e"))
    grid = uniform_grid(spans.withColumn("e", F.col("e") - 1), GRP, HOUR, 0)
    dense = iv(spark, sf).filter(F.col("status") == "error").select(
        "grp", (F.col("b") - HOUR).alias("b"), (F.col("e") + HOUR).alias("e")
    )
    return ft.adaptive_sample(grid, dense, GRP, 4)


def _match_rows(spark, sf):
    from spanline.operators.segment import previous_value

    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice",
        micros("o_orderdate").alias("t"), F.quarter("o_orderdate").cast("string").alias("patch"),
        (F.dayofyear("o_orderdate") / 366.0).alias("progress"),
    )
    o = previous_value(
        o, ["o_custkey"], ["t", "o_orderkey"], "o_orderstatus", "Start",
        layout=layout_for(spark, sf, "orders", "o_custkey"),
    )
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("player")
    )
    return o.join(cust, "o_custkey")


@query("ml04_match_features")
def match_features(spark, sf):
    """Sparse feature vectors of every order."""
    _, df = ft.match_features(
        _match_rows(spark, sf), ["player", "o_orderpriority", "patch", "previous"], ["progress"],
        "o_orderstatus",
    )
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array("features")
    return df.select(
        "o_orderkey", "label", F.size(arr).alias("width"),
        F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query("ml05_outcome_classifier")
def outcome_classifier(spark, sf):
    _, df = ft.match_features(
        _match_rows(spark, sf), ["player", "o_orderpriority", "patch", "previous"], ["progress"],
        "o_orderstatus",
    )
    n = df.schema["label"].metadata["ml_attr"]["vals"]
    return ft.outcome_classifier(df.select("o_orderkey", "features", "label"), "o_orderkey", len(n), 1234)


LABELS = ["click", "error", "purchase", "signup", "view"]


STAY, MOVE = float(np.log(0.6)), float(np.log(0.1))


@query(
    "ml06_viterbi_smooth",
    f"""with recursive {FRAMES},
s as (select grp, t * 1000 + event_id % 1000 as t, list_transform(['click','error','purchase','signup','view'],
   lambda v: case when label = v then -0.5::double else -1.5::double end) as o from frames),
r as (select *, row_number() over (partition by grp order by t) as rn, count(*) over (partition by grp) as n from s),
fwd as (select grp, rn, list_transform(o, lambda x: {float(np.log(0.2))!r}::double + x) as best from r where rn = 1
  union all select r.grp, r.rn, list_transform(range(1, 6), lambda j: list_max(list_transform(range(1, 6),
     lambda i: f.best[i] + case when i = j then {STAY!r}::double else {MOVE!r}::double end)) + r.o[j])
  from fwd f join r on r.grp = f.grp and r.rn = f.rn + 1),
back as (select f.grp, f.rn, list_position(f.best, list_max(f.best)) as s from fwd f join r on r.grp = f.grp and r.rn = f.rn
   where r.rn = r.n
  union all select f.grp, f.rn, list_position(c.v, list_max(c.v)) from back b join fwd f on f.grp = b.grp and f.rn = b.rn - 1,
   lateral (select list_transform(range(1, 6), lambda i: f.best[i] + case when i = b.s then {STAY!r}::double
     else {MOVE!r}::double end) as v) c)
select r.grp, r.t, (s - 1)::int as state from back join r on r.grp = back.grp and r.rn = back.rn""",
)
def viterbi_smooth(spark, sf):
    """Smoothed labels of every user's event stream under sticky transitions."""
    k = len(LABELS)
    trans = np.log(np.full((k, k), 0.1) + np.eye(k) * 0.5)
    init = np.log(np.full(k, 1.0 / k))
    scores = frames(spark, sf).select(
        "grp", F.struct("t", "event_id").alias("at"), "event_id",
        F.array(
            *[F.when(F.col("label") == v, F.lit(-0.5)).otherwise(F.lit(-1.5)) for v in LABELS]
        ).alias("scores"),
        "t",
    )
    # times of one user are distinct but for chance, so the event id breaks ties
    ordered = scores.withColumn("t", F.col("t") * 1000 + F.pmod("event_id", F.lit(1000)))
    return ft.viterbi_smooth(
        ordered.select("grp", "t", "scores"), trans, init, GRP, layout=events_layout(spark, sf)
    )


@query(
    "ud01_score_batches",
    """with w as (select label % 2 as mode, vec_id, embedding as x from embeddings),
s as (select mode, vec_id, list_transform(range(4), lambda c: list_sum(list_transform(range(1, 65),
   lambda i: x[i]::double * (((i * (c + 1) + case when mode = 1 then 3 else 0 end) % 7) - 3)))) as sc from w)
select vec_id, (list_position(sc, list_max(sc)) - 1)::int as best, round(list_max(sc), 5) as score from s""",
)
def score_batches(spark, sf):
    def weights(shift):
        return np.array([[((i * (c + 1) + shift) % 7) - 3 for i in range(1, 65)] for c in range(4)])

    df = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 2).cast("string").alias("mode"), "embedding"
    )
    out = ft.score_batches(df, {"base": weights(0), "1": weights(3)}, "mode", "vec_id", "embedding")
    return out.withColumn("score", F.round("score", 5))


@query(
    "ud02_timeline_fold",
    f"""with {FRAMES}, f as (select grp, t // 86400000000 as day, label, t, event_id from frames)
select grp, day, count(*) as n, string_agg(label[1], '' order by t, event_id) as letters from f group by 1, 2""",
)
def timeline_fold(spark, sf):
    """A user-supplied fold per user and day: initial letters in order."""
    from spanline.operators.folds import timeline_fold as fold_over

    def letters(rows):
        rows = list(rows)
        yield {
            "grp": rows[0]["grp"], "day": rows[0]["day"], "n": len(rows),
            "letters": "".join(r["label"][0] for r in rows),
        }

    f = frames(spark, sf).select(
        "grp", F.floor(F.col("t") / (24 * HOUR)).alias("day"), "label", "t", "event_id"
    )
    return fold_over(
        f, ["grp", "day"], ["t", "event_id"], letters,
        "grp bigint, day bigint, n bigint, letters string",
    )


@query(
    "ud03_interval_udtf",
    f"""with {IV} select grp, status, b + (i - 1) * 7200000000 as b, least(e, b + i * 7200000000) as e
from iv, unnest(generate_series(1, greatest(1, ((e - b) + 7199999999) // 7200000000))) g(i)""",
)
def interval_udtf(spark, sf):
    """Intervals cut into pieces of at most two hours by a table function in a lateral join."""
    from spanline.functions.table_functions import register

    register(spark)
    iv(spark, sf).createOrReplaceTempView("iv_to_cut")
    return spark.sql(
        "select grp, status, p.b, p.e from iv_to_cut, lateral cut_interval(b, e, 7200000000L) p"
    )


@query(
    "ud03_union_clip",
    f"""with {FRAMES},
x as (select grp, t - 21600000000 as b, t + k::bigint * 600000000 as e from frames),
m as (select *, max(e) over (partition by grp order by b, e
        rows between unbounded preceding and 1 preceding) as reach from x),
g as (select *, sum(case when b <= reach then 0 else 1 end) over (partition by grp order by b, e
        rows unbounded preceding) as i from m),
u as (select grp, min(b) as b, max(e) as e from g group by grp, i)
select grp, greatest(b, 1704412800000000) as b, least(e, 1706140800000000) as e from u
where greatest(b, 1704412800000000) <= least(e, 1706140800000000)""",
)
def union_clip(spark, sf):
    """What is covered between 5 and 25 January, by a table function over a sorted table."""
    from spanline.functions.table_functions import register

    register(spark)
    f = frames(spark, sf).select(
        F.col("grp").cast("bigint").alias("span_key"),
        (F.col("t") - 6 * HOUR).alias("b"),
        (F.col("t") + F.col("k").cast("bigint") * 600_000_000).alias("e"),
    )
    f.createOrReplaceTempView("spans_to_unite")
    return spark.sql(
        "select span_key as grp, b, e from union_clip(table(spans_to_unite) "
        "partition by span_key order by (b, e), 1704412800000000L, 1706140800000000L)"
    )


@query(
    "ud04_weighted_mode",
    f"""with {IV}, p as (select grp, status, sum(e - b) as d, min(b) as seen from iv group by 1, 2)
select grp, status as mode from p qualify row_number() over (partition by grp order by d desc, seen) = 1""",
)
def weighted_mode(spark, sf):
    from spanline.operators.votes import duration_mode

    return duration_mode(iv(spark, sf), GRP).select("grp", F.col("status").alias("mode"))
