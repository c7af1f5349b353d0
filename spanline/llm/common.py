"""Helpers of the training-text operators: tables, keys, ranks that no single task computes."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


class Shared:
    """Tables of one run, written to the shared folder and read back.

    They cut the lineage: a lost executor costs the tasks it ran, not the steps before.
    The folder is the one the cluster names in ``spark.checkpoint.dir``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """``out``: the sum of ``value`` over the rows ahead within ``keys``.

    Rows are ordered by ``bucket``, then by ``order``; ``bucket`` takes a number of
    values fixed by the caller, so that a key with a third of all rows is spread over
    as many tasks.  Sums per bucket are added up first (one row per key and bucket).
    ``df`` has to give the same rows each time it is read.
    """
    b = f"_{out}_bucket"
    rows = df.withColumn(b, bucket)
    sums = rows.groupBy(*keys, b).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(b).alias("_k_b"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy(*keys, b).orderBy(*order)
    ahead_in = within.rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(ahead_in), F.lit(0))
    same = F.col(b).eqNullSafe(F.col("_k_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        rows.withColumn("_here", here)
        .join(starts, same)
        .withColumn(out, F.col("_start") + F.col("_here"))
        .drop(b, "_here", "_start", "_k_b", *[f"_k_{k}" for k in keys])
    )
