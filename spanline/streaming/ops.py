"""Streaming operators: events in as a streaming DataFrame, results out as one.

Event time is a TIMESTAMP column with a watermark; rows older than the watermark
are dropped by the stateful operators and counted in the query's progress.
Windows and sessions pre-aggregate per task before their shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanline.operators.intervals import coalesce_intervals, run_length_encode
from spanline.session import cut_lineage
from spanline.streaming.intervals import IntervalProcessor
from spanline.timeunits import micros

KEY_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def read_events(
    spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, glob: str | None = None, files: int = 1000
) -> DataFrame:
    """Parquet files as a stream, at most ``files`` per batch; ``ts`` becomes a TIMESTAMP."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sessions(
    df: DataFrame, keys: Sequence[str], ts: str, gap: str, watermark: str
) -> DataFrame:
    """Gap sessions ``(keys, b, e, n)``; ``e`` is the last event, as in batch."""
    return (
        df.withWatermark(ts, watermark)
        .groupBy(*keys, F.session_window(ts, gap).alias("_w"))
        .agg(F.min(ts).alias("b"), F.max(ts).alias("e"), F.count(F.lit(1)).alias("n"))
        .drop("_w")
    )


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """The same event within the horizon once."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_tumbling_votes(
    df: DataFrame, keys: Sequence[str], ts: str, width: str, watermark: str
) -> DataFrame:
    """Label counts per fixed window."""
    return (
        df.withWatermark(ts, watermark)
        .groupBy(F.window(ts, width).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")
    )


def stream_sliding_feed(
    df: DataFrame, keys: Sequence[str], ts: str, width: str, slide: str, watermark: str, value: str
) -> DataFrame:
    """Per sliding window the number of visible events and the newest one."""
    return (
        df.withWatermark(ts, watermark)
        .groupBy(F.window(ts, width, slide).alias("_w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by(value, F.struct(F.col(ts), F.col(value))).alias("newest"),
        )
        .select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n", "newest")
    )


def stream_enrich(df: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream rows with the columns of a static table."""
    return df.join(static, key, "left")


def stream_match(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, other_ts: str, within: str, watermark: str
) -> DataFrame:
    """Pairs of rows of two streams within a time distance; state is bounded by both watermarks."""
    a = left.withWatermark(ts, watermark)
    b = right.withWatermark(other_ts, watermark)
    near = F.expr(f"interval {within}")
    on = (F.col(other_ts) >= F.col(ts) - near) & (F.col(other_ts) <= F.col(ts) + near)
    for k in keys:
        on = on & (a[k] == b[k])
    return a.join(b, on).drop(*[b[k] for k in keys])


def stream_intervals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    label: str,
    watermark: str,
    order: Sequence[str] = (),
    idle: int | None = None,
) -> DataFrame:
    """Run-length encoding of a stream, ``(keys, b, e, status, n)``, in Spark's keyed state.

    Samples may arrive in any order within the watermark: they wait in the state of their
    key until it has passed them, and are then encoded in order of time, so the batches of
    a stream do not show in its result.  An interval is given when a later one begins.
    With ``idle`` (microseconds) a longer silence ends it, too: by a timer where no sample
    follows, after which the key holds no state.  Later samples are dropped and counted
    (:func:`dropped_rows`); samples without a time or with a null key part count as the
    batch operator counts them: no time, no sample; null is a key.  Times up to 1970 are late
    from the start, as Spark's first watermark stands there.

    The state of a key is its open interval and the samples that the watermark has not
    passed; one task of a batch holds those of one key.  Needs the RocksDB state store:
    it is set for the session unless one is named already.
    """
    spark = df.sparkSession
    if spark.conf.get(STATE_PROVIDER, None) in (None, "") or "HDFSBacked" in spark.conf.get(STATE_PROVIDER):
        spark.conf.set(STATE_PROVIDER, ROCKSDB)
    keys, order = list(keys), list(order)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # watermarks are whole milliseconds: a sample is passed once its own millisecond is over
    # a null among grouping columns mixes keys up in the Python operator: keys travel as one text
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false", **KEY_FORMAT})
    samples = (
        df.filter(F.col(ts).isNotNull())
        .select(key.alias("sample_key"), micros(ts).alias("sample_t"), F.col(label).alias("sample_label"), *order)
        .withColumn("sample_at", F.timestamp_millis(F.ceil(F.col("sample_t") / 1000)))
        .withWatermark("sample_at", watermark)
    )
    held = ", ".join(["sample_t bigint", f"sample_label {types[label]}", *[f"{c} {types[c]}" for c in order]])
    interval = f"b bigint, e bigint, status {types[label]}, n bigint"
    done = samples.groupBy("sample_key").transformWithStateInPandas(
        statefulProcessor=IntervalProcessor("sample_key", held, interval, idle),
        outputStructType=f"sample_key string, {interval}",
        outputMode="append",
        timeMode="EventTime",
    )
    parts = F.from_json("sample_key", ", ".join(f"{c} {types[c]}" for c in keys), KEY_FORMAT)
    return done.withColumn("sample_key", parts).select("sample_key.*", "b", "e", "status", "n")


def stream_rle(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    label: str,
    order: Sequence[str],
    out: str,
    state: str,
    checkpoint: str,
) -> StreamingQuery:
    """Run-length encoding across micro-batches, for samples that arrive in time order.

    For backfills: :func:`stream_intervals` is the form with keyed state.  Each batch is encoded with the batch operator, so a timeline that dominates a
    batch is split like any other; it is joined to the interval left open by the
    batch before, closed intervals go to ``out/batch=<id>``, the open one of every
    key to ``state/batch=<id>``.  Both folders are written per batch id, so a batch
    that is run again gives the same files.
    """
    keys = list(keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = run_length_encode(batch, keys, t, label, order).drop("n")
        if batch_id > 0:
            new = new.unionByName(spark.read.parquet(f"{state}/batch={batch_id - 1}"))
        # used for state and output: computed once
        merged = cut_lineage(coalesce_intervals(new, keys))
        open_b = merged.groupBy(*keys).agg(F.max("b").alias("_open"))
        marked = merged.join(open_b, keys)
        for path, keep in (
            (state, F.col("b") == F.col("_open")),
            (out, F.col("b") < F.col("_open")),
        ):
            marked.filter(keep).drop("_open").write.mode("overwrite").parquet(
                f"{path}/batch={batch_id}"
            )

    return (
        df.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def publish_batches(
    df: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand every micro-batch with its id to ``send``, which must be idempotent by id."""
    return (
        df.writeStream.foreachBatch(send)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files until the present input is used up."""
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def dropped_rows(query: StreamingQuery) -> int:
    """Rows (after partial aggregation) the stateful operators dropped as late."""
    return sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
