"""Segmentation: rounds, games, boundaries, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.operators.intervals import coalesce_intervals
from spanline.ordered import LastValue, Layout, Next, Prev, RunSum, nearest_rows, scan

ORDER = ["b", "e"]


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    first: str,
    out: str = "previous",
    layout: Layout | None = None,
) -> DataFrame:
    """Value of the row before, ``first`` on a key's first row."""
    df = scan(df, keys, order, {out: Prev(value), "_seen": Prev(F.lit(1))}, layout)
    return df.withColumn(
        out, F.when(F.col("_seen").isNull(), F.lit(first)).otherwise(F.col(out))
    ).drop("_seen")


def version_intervals(
    df: DataFrame, begin: str, asof: str | None = None, layout: Layout | None = None
) -> DataFrame:
    """Begin dates to ``[begin, next begin)`` with the length in days; the latest stays open
    to ``asof``."""
    out = scan(df, [], [begin], {"end": Next(begin)}, layout)
    if asof is not None:
        out = out.withColumn("end", F.coalesce("end", F.lit(asof).cast("date")))
    return out.withColumn("length_days", F.datediff("end", begin))


def relabel_pauses(
    iv: DataFrame,
    keys: Sequence[str],
    short: int,
    min_between: int,
    game: str = "game",
    not_game: str = "not_game",
    pause: str = "pause",
    paused_out: str = "pause_not_game",
    layout: Layout | None = None,
) -> DataFrame:
    """Rename ``not_game`` next to pauses, then coalesce.

    Short ones beside a pause become the pause, short ones of some length between
    two games an off-game pause, long ones after a pause as well.
    """
    layout = layout or Layout.inspect(iv, keys)
    iv = coalesce_intervals(iv, keys, None, layout)
    df = scan(iv, keys, ORDER, {"_p": Prev("status"), "_n": Next("status")}, layout)
    dur = F.col("e") - F.col("b")
    p, n = F.col("_p"), F.col("_n")
    beside = F.coalesce(p == pause, F.lit(False)) | F.coalesce(n == pause, F.lit(False))
    between = F.coalesce((p == game) & (n == game), F.lit(False)) & (dur >= min_between)
    new = (
        F.when(F.col("status") != not_game, F.col("status"))
        .when((dur <= short) & between, F.lit(paused_out))
        .when((dur <= short) & beside, F.lit(pause))
        .when((dur > short) & (p == pause), F.lit(paused_out))
        .otherwise(F.col("status"))
    )
    return coalesce_intervals(
        df.withColumn("status", new).select(*keys, "b", "e", "status"), keys, None, layout
    )


def mark_rounds(
    iv: DataFrame,
    keys: Sequence[str],
    layout: Layout,
    game: str = "game",
    not_game: str = "not_game",
    pause: str = "pause",
    openers: Sequence[str] = ("game", "smaller_window", "pause_split screen"),
) -> DataFrame:
    """State of the recording at each interval and the number of the round it is in.

    States are ``open``, ``paused`` and ``none``.  An opener starts a round where
    none runs; ``pause`` pauses until the next ``game``; ``not_game`` ends a round
    that is not paused.  The state only depends on the last game, the last opener,
    the last ``not_game`` and whether a pause came while the round ran, so running
    values give it without stepping through rows.
    """
    df = scan(iv, keys, ORDER, {"_rn": RunSum(F.lit(1))}, layout, True)
    s, rn = F.col("status"), F.col("_rn")
    df = scan(
        df,
        keys,
        ORDER,
        {
            "_game": LastValue(F.when(s == game, rn)),
            "_open": LastValue(F.when(s.isin(*openers), rn)),
            "_stop": LastValue(F.when(s == not_game, rn)),
            "_pb": Prev("e"),
            "_ps": Prev("status"),
            "_ns": Next("status"),
            "_nb": Next("b"),
        },
        layout,
        True,
    )
    running = F.col("_open").isNotNull() & (
        F.col("_stop").isNull() | (F.col("_stop") < F.col("_open"))
    )
    df = scan(
        df, keys, ORDER, {"_pauser": LastValue(F.when((s == pause) & running, rn))}, layout, True
    )
    paused = F.col("_pauser").isNotNull() & (
        F.col("_pauser") > F.coalesce("_game", F.lit(-1))
    )
    df = df.withColumn(
        "state", F.when(paused, "paused").when(running, "open").otherwise("none")
    )
    df = scan(df, keys, ORDER, {"_before": Prev("state")}, layout, True)
    starts = s.isin(*openers) & (F.coalesce("_before", F.lit("none")) == "none")
    df = df.withColumn("_starts", starts.cast("bigint"))
    return scan(df, keys, ORDER, {"round": RunSum("_starts")}, layout, True)


def segment_rounds(
    iv: DataFrame,
    keys: Sequence[str],
    min_us: int,
    game: str = "game",
    not_game: str = "not_game",
    pause: str = "pause",
    replay: str = "replay",
    small: str = "smaller_window",
    split: str = "pause_split screen",
    layout: Layout | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rounds ``(keys, round, b, e)`` longer than ``min_us`` and their parts.

    Parts are ``(keys, round, kind, type, b, e)``, times relative to the round:
    typed pauses, and replays and small windows that are followed by the game.
    """
    layout = layout or Layout.inspect(iv, keys)
    df = mark_rounds(iv, keys, layout, game, not_game, pause, (game, small, split))
    s = F.col("status")
    df = df.filter(F.col("state") != "none")
    opened = F.col("_starts") == 1
    early = opened & (s != game) & (F.col("_ps") == not_game)
    df = df.withColumn("_rb", F.when(early, F.col("_pb")).otherwise(F.col("b")))
    rounds = df.groupBy(*keys, "round").agg(
        F.min(F.when(opened, F.col("_rb"))).alias("b"),
        F.max(F.when(opened | (s == game), F.col("e"))).alias("e"),
    )
    rounds = rounds.filter(F.col("e") - F.col("b") > min_us)

    # Paused stretches: every in-game pause is its own piece, off-game rows in a
    # row form one; a piece ends where the next row begins, the last at its own end.
    state = F.col("state")
    kind = (
        F.when(opened & (s == split), F.lit("pause"))
        .when(opened & (s == small), F.lit("smaller_window"))
        .when(state == "paused", F.lit("pause"))
        .when((F.col("_ns") == game) & s.isin(replay), F.lit("replay"))
        .when((F.col("_ns") == game) & s.isin(small), F.lit("smaller_window"))
    )
    typ = F.when(opened & (s == split), F.lit("Split screen")).when(
        state == "paused",
        F.when(s == pause, F.lit("Ingame pause")).otherwise(F.lit("Out of game pause")),
    )
    df = df.withColumns({"kind": kind, "type": typ})
    df = scan(df, keys, ORDER, {"_pt": Prev("type")}, layout, True)
    off = F.col("type") == "Out of game pause"
    new = ~F.coalesce(off & (F.col("_pt") == "Out of game pause"), F.lit(False))
    df = df.withColumn("_newp", new.cast("bigint"))
    df = scan(df, keys, ORDER, {"_piece_no": RunSum("_newp")}, layout)
    ends = F.when(
        state == "paused", F.coalesce(F.col("_nb"), F.col("e"))
    ).otherwise(F.col("e"))
    parts = (
        df.filter(F.col("kind").isNotNull())
        .groupBy(*keys, "round", "_piece_no", "kind", "type")
        .agg(F.min("b").alias("b"), F.max(ends).alias("e"))
        .drop("_piece_no")
    )
    base = rounds.select(*keys, "round", F.col("b").alias("_rb"))
    parts = (
        parts.join(base, [*keys, "round"])
        .withColumn("b", F.col("b") - F.col("_rb"))
        .withColumn("e", F.col("e") - F.col("_rb"))
        .drop("_rb")
    )
    return rounds, parts


def attach_within(
    iv: DataFrame,
    rounds: DataFrame,
    keys: Sequence[str],
    round_id: str,
    layout: Layout | None = None,
) -> DataFrame:
    """Intervals that begin inside a round, relative to it; rounds do not overlap."""
    r = rounds.select(*keys, F.col(round_id), "b", "e")
    hit = nearest_rows(iv, r, keys, "b", "b", before="_r", layout=layout)
    return hit.filter(F.col("b") <= F.col("_r.e")).select(
        *keys,
        F.col("_r")[round_id].alias(round_id),
        (F.col("b") - F.col("_r.b")).alias("b"),
        (F.col("e") - F.col("_r.b")).alias("e"),
        "status",
    )


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    layout: Layout | None = None,
) -> DataFrame:
    """Missing values taken from the last row that has one."""
    filled = scan(df, keys, order, {f"_{c}_ff": LastValue(c) for c in cols}, layout)
    return filled.withColumns({c: F.col(f"_{c}_ff") for c in cols}).drop(
        *[f"_{c}_ff" for c in cols]
    )


def segment_games(
    rounds: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    map_col: str,
    layout: Layout | None = None,
) -> DataFrame:
    """A new game where the map changes; round numbers restart in it."""
    layout = layout or Layout.inspect(rounds, keys)
    df = scan(
        rounds, keys, order, {"_p": Prev(map_col), "_s": Prev(F.lit(1)), "_rn": RunSum(F.lit(1))},
        layout, True,
    )
    new = F.col("_s").isNull() | ~F.col("_p").eqNullSafe(F.col(map_col))
    df = df.withColumn("_new", new.cast("bigint"))
    df = scan(
        df, keys, order,
        {"game_number": RunSum("_new"), "_start": LastValue(F.when(new, F.col("_rn")))},
        layout,
    )
    return df.withColumn("round_number", F.col("_rn") - F.col("_start") + 1).drop(
        "_p", "_s", "_rn", "_new", "_start"
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "n",
    layout: Layout | None = None,
) -> DataFrame:
    """1, 2, ... in order."""
    return scan(df, keys, order, {out: RunSum(F.lit(1))}, layout)


def refine_boundary(
    coarse: DataFrame,
    fine: DataFrame,
    keys: Sequence[str],
    step: int,
    t: str = "t",
    layout: Layout | None = None,
    tail: int = 0,
) -> DataFrame:
    """Replace coarse bounds by the earliest / latest matching fine sample near them.

    The begin looks one ``step`` back, the end one ``step`` to both sides; ``fine``
    holds the samples with the wanted label.  A found end is ``tail`` behind its sample.
    """
    f = fine.select(*keys, F.col(t).alias("_t"))
    df = coarse.withColumns({"_from": F.col("b") - step, "_to": F.col("e") + step})
    df = nearest_rows(df, f, keys, "_from", "_t", after="_a", table_first=False, layout=layout)
    df = nearest_rows(df, f, keys, "_to", "_t", before="_z", layout=layout)
    first, last = F.col("_a._t"), F.col("_z._t")
    return df.withColumns(
        {
            "b": F.when(first <= F.col("b"), first).otherwise(F.col("b")),
            "e": F.when(last >= F.col("e") - step, last + tail).otherwise(F.col("e")),
        }
    ).drop("_from", "_to", "_a", "_z")


def probe_start(parts: DataFrame, rounds: DataFrame, keys: Sequence[str], limit: int, pad: int):
    """Where a round is worth probing: after its first early small window, else replay, else
    pause, else at once."""
    early = parts.filter(F.col("b") < limit)
    rank = (
        F.when(F.col("kind") == "smaller_window", 1).when(F.col("kind") == "replay", 2).otherwise(3)
    )
    best = early.groupBy(*keys, "round").agg(
        F.min_by("e", F.struct(rank, F.col("b"), F.col("e"))).alias("_e")
    )
    return (
        rounds.select(*keys, "round")
        .join(best, [*keys, "round"], "left")
        .withColumn("start", F.coalesce(F.col("_e") + pad, F.lit(0).cast("bigint")))
        .drop("_e")
    )
