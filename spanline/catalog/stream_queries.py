"""Streaming operators over the events table (ST-01 .. ST-09).

A window is final once the watermark (latest event minus the delay) has passed
it; the SQL forms ask for the same windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import FRAMES, IV, SESSIONS, table
from spanline.session import scratch_path
from spanline.streaming import ops
from spanline.timeunits import micros


def _events(spark, sf):
    table(spark, sf, "events")  # sets the session zone
    return ops.read_events(spark, sf, glob="events.parquet").select(
        F.col("user_id").alias("grp"), "ts", F.col("event_type").alias("label"), "event_id"
    )


def _run(spark, df, name):
    out = scratch_path(spark, name)
    ops.run_to_files(df, out, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


@query(
    "st01_stream_rle",
    f"""with {IV} select grp, b, e, status from iv
qualify row_number() over (partition by grp order by b desc, e desc) > 1""",
)
def stream_rle(spark, sf):
    """Closed intervals; the last one of every user is still open."""
    df = ops.stream_intervals(_events(spark, sf), ["grp"], "ts", "label", "0 seconds", ["event_id"])
    return _run(spark, df, "rle").select("grp", "b", "e", "status")


@query(
    "st02_stream_sessions",
    f"""with {FRAMES},{SESSIONS} select grp, b, e, n from sessions
where e + 43200000000 <= (select max(t) - 3600000000 from frames)""",
)
def stream_sessions(spark, sf):
    df = ops.stream_sessions(_events(spark, sf), ["grp"], "ts", "12 hours", "1 hour")
    done = _run(spark, df, "sessions")
    return done.select("grp", micros("b").alias("b"), micros("e").alias("e"), "n")


@query("st03_stream_dedup", f"with {FRAMES} select distinct grp, label from frames")
def stream_dedup(spark, sf):
    df = ops.stream_dedup(_events(spark, sf), ["grp", "label"], "ts", "60 days")
    return _run(spark, df.select("grp", "label"), "dedup")


@query(
    "st04_stream_tumbling_votes",
    f"""with {FRAMES}, w as (select t // 86400000000 * 86400000000 as start, label, count(*) as n
  from frames group by 1, 2)
select start, label, n from w where start + 86400000000 <= (select max(t) - 3600000000 from frames)""",
)
def stream_tumbling_votes(spark, sf):
    df = ops.stream_tumbling_votes(_events(spark, sf), ["label"], "ts", "1 day", "1 hour")
    return _run(spark, df, "votes").select(micros("start").alias("start"), "label", "n")


@query(
    "st05_stream_sliding_feed",
    f"""with {FRAMES}, w as (select grp, t, event_id, unnest([0, 1, 2, 3]) as i from frames),
s as (select grp, t, event_id, (t // 43200000000 - i) * 43200000000 as start from w)
select start, grp, count(*) as n, arg_max(event_id, (t, event_id)) as newest from s group by start, grp
having start + 172800000000 <= (select max(t) - 3600000000 from frames)""",
)
def stream_sliding_feed(spark, sf):
    df = ops.stream_sliding_feed(
        _events(spark, sf), ["grp"], "ts", "48 hours", "12 hours", "1 hour", "event_id"
    )
    return _run(spark, df, "feed").select(micros("start").alias("start"), "grp", "n", "newest")


@query(
    "st06_stream_enrich",
    """select event_id, event_type as label, c_name as name, c_mktsegment as segment from events
left join customer on c_custkey = user_id""",
)
def stream_enrich(spark, sf):
    static = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("grp"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    df = ops.stream_enrich(_events(spark, sf), static, "grp")
    return _run(spark, df.select("event_id", "label", "name", "segment"), "enrich")


@query(
    "st07_stream_match",
    f"""with {FRAMES} select d.grp, d.event_id, f.event_id as fid from frames d join frames f on f.grp = d.grp
  and f.t between d.t - 50400000000 and d.t + 50400000000 where d.label = 'purchase' and f.label = 'error'""",
)
def stream_match(spark, sf):
    ev = _events(spark, sf)
    left = ev.filter("label = 'purchase'").select("grp", "event_id", "ts")
    right = _events(spark, sf).filter("label = 'error'").select(
        "grp", F.col("event_id").alias("fid"), F.col("ts").alias("fts")
    )
    df = ops.stream_match(left, right, ["grp"], "ts", "fts", "14 hours", "1 day")
    return _run(spark, df.select("grp", "event_id", "fid"), "match")


@query(
    "st08_late_data",
    """with e as (select epoch_us(ts) as t, event_type as label, event_id,
  (select min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 from events) as half from events),
w as (select t // 86400000000 * 86400000000 as start, label, count(*) as n from e where t >= half group by 1, 2)
select start, label, n from w where start + 86400000000 <= (select max(t) - 3600000000 from e)""",
)
def late_data(spark, sf):
    """The earlier half arrives after the later one: it is behind the watermark and dropped."""
    src, out = scratch_path(spark, "late-in"), scratch_path(spark, "late")
    check = scratch_path(spark, "late-checkpoint")
    ev = table(spark, sf, "events")
    us = micros("ts")
    span = ev.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    half = span["lo"] + (span["hi"] - span["lo"]) // 2
    for part in (ev.filter(us >= half), ev.filter(us < half)):
        part.write.mode("append").parquet(src)
        stream = ops.read_events(spark, src).withColumnRenamed("event_type", "label")
        df = ops.stream_tumbling_votes(stream, ["label"], "ts", "1 day", "1 hour")
        ops.run_to_files(df, out, check)
    return spark.read.schema(df.schema).parquet(out).select(
        micros("start").alias("start"), "label", "n"
    )


@query(
    "st09_publish_batches",
    "select event_type as label, count(*) as n from events group by 1",
)
def publish_batches(spark, sf):
    out = scratch_path(spark, "published")

    def send(batch, batch_id):
        batch.write.mode("overwrite").json(f"{out}/batch={batch_id}")

    q = ops.publish_batches(
        _events(spark, sf).select("event_id", "label"), send, scratch_path(spark, "pub-checkpoint")
    )
    q.awaitTermination()
    docs = spark.read.schema("event_id BIGINT, label STRING").json(out)
    return docs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
