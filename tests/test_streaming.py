"""Streams fed in several batches equal the batch operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanline.operators import intervals
from spanline.sources import sinks
from spanline.streaming import ops

DDL = "g int, i int, t bigint, label string"


def test_rle_over_batches(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.7 else 2, i, i, rnd.choice("aab")) for i in range(120)]
    src, out, state, check = (str(tmp_path / n) for n in ("src", "out", "state", "check"))
    for k in range(4):
        part = [r for r in rows if r[2] // 30 == k]
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DDL).parquet(src)
        q = ops.stream_rle(stream, ["g"], "t", "label", ["i"], out, state, check)
        q.awaitTermination()
    closed = spark.read.parquet(out).select("g", "b", "e", "status")
    still = spark.read.parquet(f"{state}/batch=3").select("g", "b", "e", "status")
    batch = intervals.run_length_encode(spark.createDataFrame(rows, DDL), ["g"], "t", "label", ["i"])
    want = sorted(map(tuple, batch.select("g", "b", "e", "status").collect()))
    assert sorted(map(tuple, closed.unionByName(still).collect())) == want


def test_late_rows_are_counted(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    ddl = "ts timestamp, label string"
    dropped = 0
    for hours in ([100, 101], [1, 2]):
        rows = spark.createDataFrame([(h,) for h in hours], "h int").select(
            F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit("x").alias("label")
        )
        rows.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        df = ops.stream_tumbling_votes(stream, ["label"], "ts", "1 hour", "1 hour")
        dropped = ops.dropped_rows(ops.run_to_files(df, out, check))
    assert dropped == 2


def test_publish_sends_every_document(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string").alias("doc")).repartition(3)
    target = str(tmp_path)

    def send(docs):
        import os
        import uuid

        with open(os.path.join(target, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(docs) + "\n")

    sinks.publish(df, send, batch=4)
    got = [line for p in tmp_path.iterdir() for line in p.read_text().split()]
    assert sorted(got, key=int) == [str(i) for i in range(25)]


def _fed(spark, tmp_path, parts, idle, watermark):
    """Closed intervals after each part has been a run of its own, and the rows dropped."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    ddl = "g int, i int, ts timestamp, label string"
    dropped, held = 0, []
    for part in parts:
        rows = spark.createDataFrame(part, "g int, i int, t bigint, label string").select(
            "g", "i", F.timestamp_micros("t").alias("ts"), "label"
        )
        rows.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        df = ops.stream_intervals(stream, ["g"], "ts", "label", watermark, ["i"], idle)
        run = ops.run_to_files(df, out, check)
        dropped += ops.dropped_rows(run)
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.schema("g int, b bigint, e bigint, status string, n bigint").parquet(out)
    return sorted(map(tuple, got.collect()), key=str), dropped, held


def _encoded(rows, passed, idle):
    """Intervals over by the time ``passed``, one sample after the other."""
    by_key = {}
    for g, i, t, label in sorted(rows, key=lambda r: (r[2], r[1])):
        if t > passed:
            continue
        runs = by_key.setdefault(g, [])
        silent = runs and idle is not None and t - runs[-1][2] > idle
        if runs and runs[-1][3] == label and not silent:
            runs[-1] = (*runs[-1][:2], t, label, runs[-1][4] + 1)
        else:
            runs.append((g, t, t, label, 1))
    return sorted(
        (
            run
            for runs in by_key.values()
            for n, run in enumerate(runs)
            if n + 1 < len(runs) or (idle is not None and passed >= run[2] + idle)
        ),
        key=str,
    )


def test_intervals_in_keyed_state(spark, tmp_path):
    """Samples out of order over batches, ties, null labels and keys: as if all were there at once."""
    rnd = random.Random(4)
    second = 1_000_000
    rows = [
        (rnd.choice([1, 1, 1, 2, None]), i, (i // 2) * second + 123, rnd.choice(["a", "a", "b", None]))
        for i in range(160)
    ]
    late = sorted(rows, key=lambda r: r[2] + rnd.randrange(8) * second)  # at most 8 s late
    parts = [late[n : n + 40] for n in range(0, 160, 40)]
    got, dropped, _ = _fed(spark, tmp_path, parts, None, "20 seconds")
    passed = -(-max(r[2] for r in rows) // 1000) * 1000 - 20 * second
    assert dropped == 0
    want = _encoded(rows, passed, None)
    assert got == want and len(got) > 30


def test_idle_keys_hold_no_state(spark, tmp_path):
    """A silence longer than ``idle`` ends an interval; late samples are dropped and counted."""
    at = [n * 1_000_000 for n in range(111)]
    first = [(1, 0, at[10], "a"), (1, 1, at[11], "a"), (1, 2, at[19], "a"), (2, 3, at[12], "b")]
    later = [(3, 4, at[110], "c")]
    too_late = [(1, 5, at[13], "z"), (2, 6, at[14], "b")]
    got, dropped, held = _fed(spark, tmp_path, [first, later, too_late], 5_000_000, "0 seconds")
    assert got == [
        (1, at[10], at[11], "a", 2), (1, at[19], at[19], "a", 1), (2, at[12], at[12], "b", 1)
    ]
    assert dropped == 2
    assert held[1] <= 3  # only key 3 is left: its interval and its timer
