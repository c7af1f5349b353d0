"""Stand-ins built from the test tables, in Spark and as SQL text.

Each has a Spark form ``(spark, sf_dir) -> DataFrame`` and a SQL form usable as a
list of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanline.operators import intervals as iv_ops
from spanline.ordered import Layout
from spanline.timeunits import HOUR, micros

GRP = ["grp"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # the tables hold TIMESTAMP_NTZ in UTC; casts to TIMESTAMP follow the session zone
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


_layouts: dict[tuple, Layout] = {}


def layout_for(spark: SparkSession, sf: str, name: str, key: str) -> Layout:
    """Group sizes of a read-only test table, counted once per session and limit."""
    from spanline.session import max_group_rows

    tag = (spark.sparkContext.applicationId, max_group_rows(spark), sf, name, key)
    if tag not in _layouts:
        _layouts[tag] = Layout.inspect(table(spark, sf, name), [key])
    return _layouts[tag]


def events_layout(spark: SparkSession, sf: str) -> Layout:
    return layout_for(spark, sf, "events", "user_id")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("grp"),
        micros("ts").alias("t"),
        F.col("event_type").alias("label"),
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def iv(spark: SparkSession, sf: str) -> DataFrame:
    return iv_ops.run_length_encode(
        frames(spark, sf), GRP, "t", "label", ["event_id"], events_layout(spark, sf)
    ).drop("n")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    df = iv_ops.gap_sessions(
        frames(spark, sf), GRP, "t", 12 * HOUR, ["event_id"], events_layout(spark, sf)
    )
    return df.groupBy("grp", F.col("_session").alias("sid")).agg(
        F.min("t").alias("b"), F.max("t").alias("e"), F.count(F.lit(1)).alias("n")
    )


FRAMES = """frames as (
  select user_id as grp, epoch_us(ts) as t, event_type as label, event_id, value,
         cast(json_extract_string(props, '$.k') as int) as k
  from events)"""

RLE = """
chg as (select *, case when lag(label) over w is distinct from label then 1 else 0 end as f
        from frames window w as (partition by grp order by t, event_id)),
isl as (select *, sum(f) over (partition by grp order by t, event_id
                               rows unbounded preceding) as g from chg),
iv as (select grp, min(t) as b, max(t) as e, any_value(label) as status, count(*) as n
       from isl group by grp, g)"""

IV = FRAMES + "," + RLE

SESSIONS = """
gaps as (select *, case when t - lag(t) over (partition by grp order by t, event_id) <= 43200000000
                        then 0 else 1 end as sf from frames),
numbered as (select *, sum(sf) over (partition by grp order by t, event_id
                                     rows unbounded preceding) as sid from gaps),
sessions as (select grp, cast(sid as bigint) as sid, min(t) as b, max(t) as e, count(*) as n
             from numbered group by grp, sid)"""


def coalesce_sql(src: str, out: str) -> str:
    """Merge neighbours of equal status in CTE ``src`` (grp, b, e, status)."""
    return f"""
{out}_c as (select *, case when lag(status) over w is distinct from status then 1 else 0 end as f
   from {src} window w as (partition by grp order by b, e)),
{out}_g as (select *, sum(f) over (partition by grp order by b, e rows unbounded preceding) as g
   from {out}_c),
{out} as (select grp, min(b) as b, max(e) as e, any_value(status) as status
   from {out}_g group by grp, g)"""


def min_duration_sql(src: str, out: str, limit: str, protect: bool = False) -> str:
    """Duration filter of CTE ``src``; ``limit`` is a SQL expression, NULL keeps the row."""
    first = "or row_number() over (partition by grp order by b, e) = 1" if protect else ""
    return (
        coalesce_sql(src, f"{out}_m")
        + f""",
{out}_k as (select grp, b, e, status from {out}_m qualify
   ({limit}) is null or e - b >= ({limit})
   or row_number() over (partition by grp order by b desc, e desc) = 1 {first}),"""
        + coalesce_sql(f"{out}_k", out)
    )
