"""Second pass over recordings: exact bounds of rounds and their parts, and player names.

The first pass labels recordings in coarse steps.  The second looks at finer samples only
near the bounds it found.  Fine samples lie in folders by time slot, and a scan opens the
slots that hold a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanline.operators.joins import fuzzy_assign
from spanline.operators.segment import probe_start, refine_boundary
from spanline.operators.votes import roster_vote, side_vote
from spanline.ordered import Layout, nearest_rows
from spanline.session import cut_lineage, scratch_path
from spanline.timeunits import SECOND

SHARDS = 16


def _shard(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


def write_fine(fine: DataFrame, path: str, key: str, width: int, t: str = "t") -> None:
    """Fine samples in folders by shard of the recording and time slot of ``width``."""
    placed = fine.withColumns({"shard": _shard(key), "slot": F.floor(F.col(t) / width)})
    placed.hint("rebalance", F.col("shard"), F.col("slot")).write.mode("overwrite").partitionBy(
        "shard", "slot"
    ).parquet(path)


def read_near(
    spark: SparkSession, path: str, bounds: DataFrame, key: str, width: int, step: int
) -> DataFrame:
    """Fine samples in the folders within a ``step`` of a bound, for ``bounds`` ``(key, b, e)``.

    The folders wanted are written first: at most one row for each folder, so that Spark
    knows their size and can prune the scan with them.
    """

    def slots(c: str) -> Column:
        low, high = F.floor((F.col(c) - step) / width), F.floor((F.col(c) + step) / width)
        return F.sequence(low, high)

    wanted = scratch_path(spark, "slots")
    bounds.select(
        _shard(key).alias("shard"), F.explode(F.array_union(slots("b"), slots("e"))).alias("slot")
    ).distinct().write.parquet(wanted)
    fine = spark.read.parquet(path)
    # a comparison makes the small side worth a runtime filter to Spark; every shard passes it
    near = spark.read.parquet(wanted).filter(F.col("shard") >= 0)
    return fine.join(near, ["shard", "slot"], "left_semi").drop("shard", "slot")


def part_label(kind: Column, type: Column) -> Column:
    """The sample label a part is looked for with.  Fixed values: labels of the samples."""
    return (
        F.when(type == "Out of game pause", "not_game")
        .when(type == "Split screen", "pause_split screen")
        .otherwise(kind)
    )


def refine_rounds(
    rounds: DataFrame,
    parts: DataFrame,
    fine: DataFrame,
    key: str,
    step: int,
    fine_step: int,
    game: str = "game",
    layout: Layout | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rounds and parts with bounds to the fine step.

    ``fine`` is ``(key, t, label)``.  A begin moves to the first fine sample of its label at
    most one coarse ``step`` ahead of it; an end to one fine step behind the last within a
    ``step`` of it; a bound without such a sample stays.  Nothing moves ahead of time 0.  Times
    of parts stay relative to the begin of the round, the refined one.
    """
    begins = rounds.select(key, "round", F.col("b").alias("_rb"))
    spans = (
        rounds.select(
            key, "round", F.lit(game).alias("label"), F.lit(True).alias("_whole"),
            F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("type"), "b", "e",
        )
    ).unionByName(
        parts.join(begins, [key, "round"]).select(
            key, "round", part_label(F.col("kind"), F.col("type")).alias("label"),
            F.lit(False).alias("_whole"), "kind", "type",
            (F.col("b") + F.col("_rb")).alias("b"), (F.col("e") + F.col("_rb")).alias("e"),
        )
    )
    # samples ahead of the recording are none of it
    samples = fine.filter(F.col("t") >= 0).select(key, "label", "t")
    refined = cut_lineage(
        refine_boundary(spans, samples, [key, "label"], step, layout=layout, tail=fine_step)
    )
    found = refined.filter("_whole").select(key, "round", "b", "e")
    out = rounds.drop("b", "e").join(found, [key, "round"])
    begins = found.select(key, "round", F.col("b").alias("_rb"))
    moved = (
        refined.filter("not _whole")
        .join(begins, [key, "round"])
        .select(
            key, "round", "kind", "type",
            (F.col("b") - F.col("_rb")).alias("b"), (F.col("e") - F.col("_rb")).alias("e"),
        )
    )
    return out.select(*rounds.columns), moved.select(*parts.columns)


def players_of_rounds(
    names: DataFrame,
    rounds: DataFrame,
    parts: DataFrame,
    teams: DataFrame,
    key: str,
    early: int = 5 * SECOND,
    pad: int = 1 * SECOND,
    length: int = 5 * SECOND,
    layout: Layout | None = None,
) -> DataFrame:
    """``(key, round, side, slot, team, name, player)`` for each slot seen in a round.

    ``names`` is ``(key, side, slot, t, name)``, ``teams`` ``(key, team, name)`` with teams 1
    and 2.  Names are read for ``length`` from where a round is worth probing on
    (:func:`probe_start`).  A slot's ``name`` is the first seen that a team of the recording
    has, else the most frequent.  Team 1 is on the left if more names there are its own than
    team 2's; then every side takes its team's roster: exact names first, the other slots
    in order the closest name still free.
    """
    starts = probe_start(parts, rounds, [key], early, pad)
    windows = rounds.select(key, "round", "b").join(starts, [key, "round"]).select(
        key, "round", (F.col("b") + F.col("start")).alias("from")
    )
    near = nearest_rows(names, windows, [key], "t", "from", before="_w", layout=layout)
    read = near.filter(F.col("t") < F.col("_w.from") + length).select(
        key, F.col("_w.round").alias("round"), "side", "slot", "t", "name"
    )
    slot = [key, "round", "side", "slot"]
    # a roster is that of the recording, so the recording is part of the name voted on
    tagged = read.withColumn("_name", F.struct(F.col(key).alias("of"), F.col("name").alias("n")))
    roster = teams.select(F.struct(F.col(key).alias("of"), F.col("name").alias("n")).alias("_name"))
    voted = roster_vote(tagged, slot, "_name", roster, ["t", "name"]).select(
        *slot, F.col("_name.n").alias("name")
    )
    member = teams.groupBy(key, "name").agg(F.min("team").alias("_team"))
    hits = voted.join(member, [key, "name"], "left")
    one, two = (F.coalesce(F.col("_team") == n, F.lit(False)) for n in (1, 2))
    side = side_vote(hits, [key, "round"], "side", one, two).select(key, "round", "team_one_left")
    first = (F.col("side") == "left") == F.col("team_one_left")
    placed = cut_lineage(
        voted.join(side, [key, "round"]).withColumn("team", F.when(first, 1).otherwise(2)).drop("team_one_left")
    )
    sides = placed.select(key, "round", "side", "team").distinct()
    rosters = sides.join(teams, [key, "team"]).select(key, "round", "side", "name")
    return fuzzy_assign(placed, rosters, [key, "round", "side"]).select(
        *slot, "team", "name", F.col("assigned").alias("player")
    )
