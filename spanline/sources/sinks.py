"""Writing samples, documents and event tables.

Writers leave the number of tasks to Spark.  Where a column becomes a directory,
rows are first spread with ``rebalance``: Spark cuts large directories and joins
small ones by size, so a directory holding a third of all rows is written by many
tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _spread(df: DataFrame, *cols: str) -> DataFrame:
    return df.hint("rebalance", *[F.col(c) for c in cols])


def write_samples(df: DataFrame, path: str, mode: str = "append") -> None:
    """Samples under ``mode=.../split=...``."""
    _spread(df, "mode", "split").write.mode(mode).partitionBy("mode", "split").parquet(path)


def write_dual(
    df: DataFrame,
    exists_path: str,
    sequence_path: str,
    length: str,
    flags: Sequence[str],
) -> None:
    """All rows with flags to one table, rows with content and without flags to another."""
    df.write.mode("overwrite").parquet(exists_path)
    stored = df.sparkSession.read.parquet(exists_path)
    stored.filter(F.col(length) > 1).drop(*flags).write.mode("overwrite").parquet(sequence_path)


def write_csv(df: DataFrame, path: str, header: Sequence[str]) -> None:
    """The named columns in that order, with a header line."""
    df.select(*header).write.mode("overwrite").csv(path, header=True)


def to_documents(df: DataFrame, keys: Sequence[str], out: str = "doc") -> DataFrame:
    """Every other column packed into one JSON string per row."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*keys, *rest)).alias(out))


def write_docs(df: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object per line, nested columns kept; a compressed file is read by one task."""
    df.write.mode("overwrite").json(path, compression=compression)


def publish(
    df: DataFrame, send: Callable[[list[str]], None], doc: str = "doc", batch: int = 500
) -> None:
    """Hand the documents to ``send`` in batches, in the tasks; an error fails the task.

    A retried task sends again, so ``send`` must be idempotent (PUT by id).
    """

    def run(rows: Iterator) -> None:
        pending: list[str] = []
        for row in rows:
            pending.append(row[0])
            if len(pending) == batch:
                send(pending)
                pending = []
        if pending:
            send(pending)

    df.select(doc).foreachPartition(run)


OTHER = "_other_types"


def route_events(
    df: DataFrame,
    type_col: str,
    path: str,
    columns: Mapping[str, Sequence[str]],
    pause_path: str,
    pause_mark: str = "PAUSE",
) -> None:
    """One log into a table per type with the columns of that type; pauses go elsewhere.

    Types that have no columns named, and rows without a type, go whole into ``OTHER``.
    The log is read once for each table: their columns differ.
    """
    for kind, cols in columns.items():
        df.filter(F.col(type_col) == kind).select(*cols).write.mode("overwrite").parquet(
            f"{path}/{kind}"
        )
    named = F.col(type_col).isin(*columns) | F.col(type_col).contains(pause_mark)
    df.filter(~F.coalesce(named, F.lit(False))).write.mode("overwrite").parquet(f"{path}/{OTHER}")
    df.filter(F.col(type_col).contains(pause_mark)).write.mode("overwrite").parquet(pause_path)


PAUSES = "_pauses"


def route_typed(
    df: DataFrame,
    type_col: str,
    path: str,
    columns: Mapping[str, Sequence[str]],
    pause_mark: str = "PAUSE",
) -> None:
    """:func:`route_events` in one pass over the log, read back with :func:`read_typed`.

    One write under ``route=...`` folders.  A type with columns named stores nulls in its other
    columns, which cost Parquet nothing; pauses and the rest keep every column.  A type whose
    name holds the pause mark is a pause, whether it has columns named or not.
    """
    kind = F.col(type_col)
    named = {k: cols for k, cols in columns.items() if pause_mark not in k}
    route = F.when(kind.contains(pause_mark), PAUSES).when(kind.isin(*named), kind).otherwise(OTHER)
    typed = df.withColumn("route", route)
    for c in df.columns:
        lacking = [k for k, cols in named.items() if c not in cols]
        if lacking:
            typed = typed.withColumn(c, F.when(~F.col("route").isin(*lacking), F.col(c)))
    _spread(typed, "route").write.mode("overwrite").partitionBy("route").parquet(path)


def read_typed(
    spark: SparkSession, path: str, route: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """One table of :func:`route_typed`: a type, ``OTHER`` or ``PAUSES``; only its folder is read."""
    df = spark.read.parquet(path).filter(F.col("route") == route).drop("route")
    return df if columns is None else df.select(*columns)


def route_by_type(df: DataFrame, type_col: str, path: str) -> None:
    """One log under ``type=...`` directories in a single pass."""
    _spread(df, type_col).write.mode("overwrite").partitionBy(type_col).parquet(path)


def purge_ids(spark: SparkSession, path: str, ids: DataFrame, key: str, target: str) -> None:
    """Copy the stored samples without the listed ids to ``target``."""
    kept = spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_anti")
    write_samples(kept, target, "overwrite")


def backfill(
    spark: SparkSession, path: str, attrs: DataFrame, key: str, col: str, target: str
) -> None:
    """Copy the stored samples with ``col`` filled per ``key`` where it is missing.

    Of several values for a key the least is taken.
    """
    df = spark.read.parquet(path)
    own = F.col(col) if col in df.columns else F.lit(None).cast("string")
    df = df.withColumn("_own", own).drop(col)
    value = attrs.groupBy(key).agg(F.min(col).alias("_new"))
    filled = (
        df.join(value, key, "left").withColumn(col, F.coalesce("_own", "_new")).drop("_own", "_new")
    )
    write_samples(filled, target, "overwrite")


def manifest(df: DataFrame, id: str, match: str, game: str, round: str) -> DataFrame:
    return df.select(
        F.col(id).alias("id"), F.col(match).alias("match"), F.col(game).alias("game_number"),
        F.col(round).alias("round_number"),
    )


def wide_timeline(
    df: DataFrame, keys: Sequence[str], t: str, slot: str, value: str, slots: Sequence
) -> DataFrame:
    """One row per time with a column per slot."""
    return df.groupBy(*keys, t).pivot(slot, list(slots)).agg(F.max(value))


def game_meta(rounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrays of round begins and ends per game (in parts, if a game is too long for one)."""
    from spanline.operators.votes import nest_rounds

    docs = nest_rounds(rounds, keys, ["b", "e"], [], "_p")
    return docs.select(
        *keys,
        "part",
        F.transform("_p", lambda x: x["b"]).alias("begins"),
        F.transform("_p", lambda x: x["e"]).alias("ends"),
    )
