"""Table functions against the DataFrame operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanline.functions.table_functions import register
from spanline.operators.intervals import union_intervals

DDL = "span_key bigint, b bigint, e bigint"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _united(spark, df, low, high):
    df.createOrReplaceTempView("spans_of_test")
    bounds = ", ".join("cast(null as bigint)" if x is None else f"{x}L" for x in (low, high))
    return spark.sql(
        "select * from union_clip(table(spans_of_test) partition by span_key order by (b, e), "
        f"{bounds})"
    )


def test_union_clip_over_batches(spark):
    """A key over many Arrow batches, null keys and clipped ends: as the operator gives them."""
    register(spark)
    rnd = random.Random(2)
    rows = [
        (rnd.choice([1, 1, 1, 2, None]), b, b + rnd.randrange(12))
        for b in (rnd.randrange(20_000) for _ in range(3_000))
    ]
    df = spark.createDataFrame(rows, DDL)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = _united(spark, df, None, None)
        assert "ArrowEvalPythonUDTF" in got._jdf.queryExecution().toString()
        want = union_intervals(df, ["span_key"])
        assert _rows(got) == _rows(want)
        cut = want.select(
            "span_key", F.greatest("b", F.lit(5_000)).alias("b"), F.least("e", F.lit(9_000)).alias("e")
        ).filter("b <= e")
        assert _rows(_united(spark, df, 5_000, 9_000)) == _rows(cut)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_union_clip_edges(spark):
    register(spark)
    none = spark.createDataFrame([], DDL)
    assert _united(spark, none, 0, 9).count() == 0
    rows = spark.createDataFrame([(1, None, 3), (1, 2, None), (2, 4, 4), (2, 4, 4), (2, 20, 30)], DDL)
    assert _rows(_united(spark, rows, 0, 9)) == [(2, 4, 4)]
