"""Accuracy of predicted labels and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.functions.text import mm_ss


def label_accuracy(df: DataFrame, attr: str, truth: str, predicted: str) -> DataFrame:
    """Correct / total per (attr, label) and per attr (label NULL), in one grouping-sets pass."""
    hit = F.sum((F.col(truth) == F.col(predicted)).cast("bigint"))
    grouped = df.groupingSets(
        [[F.col(attr), F.col(truth)], [F.col(attr)]], F.col(attr), F.col(truth)
    )
    return grouped.agg(
        F.grouping(truth).cast("int").alias("is_total"),
        hit.alias("correct"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("accuracy", F.col("correct") / F.col("total"))


def error_listing(
    df: DataFrame, truth: str, predicted: str, t: str, keep: Sequence[str]
) -> DataFrame:
    """Wrong predictions with truth, prediction and the time as ``mm_ss.s``."""
    return df.filter(~F.col(truth).eqNullSafe(F.col(predicted))).select(
        *keep, truth, predicted, mm_ss(F.col(t)).alias("at")
    )


def sequence_accuracy(df: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Share of rows whose two sequences are equal element by element."""
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    ok = F.sum(ca.eqNullSafe(cb).cast("bigint"))
    n = F.count(F.lit(1))
    return df.agg(ok.alias("correct"), n.alias("total")).withColumn(
        "accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0)
    )


def semantic_accuracy(
    df: DataFrame, a: Column, b: Column, fields: Sequence[str]
) -> DataFrame:
    """Share of rows whose two parsed events agree on ``fields``."""
    from spanline.functions.arrays import same_fields

    rows = df.select(same_fields(a, b, fields).alias("_ok"))
    return rows.agg(
        F.sum(F.col("_ok").cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total")
    ).withColumn("accuracy", F.col("correct") / F.col("total"))
