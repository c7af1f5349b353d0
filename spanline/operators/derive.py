"""Timelines derived from cleaned states: deaths, switches, lifecycles, effects, scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.operators.folds import timeline_fold
from spanline.operators.intervals import filter_min_duration, snap_begin
from spanline.operators.joins import not_within, require_alive, require_cause, state_at
from spanline.ordered import Layout, MaxBefore, Next, Prev, RunSum, scan

ORDER = ["b", "e"]


def rising_only(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    layout: Layout | None = None,
) -> DataFrame:
    """Rows whose value exceeds every earlier one of their key."""
    df = scan(df, keys, order, {"_top": MaxBefore(value)}, layout)
    return df.filter(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def control_flips(iv: DataFrame, keys: Sequence[str], prefix: str = "Control") -> DataFrame:
    """Begin of each controlled stretch with its side; ``neither`` is left out."""
    s = F.col("status")
    side = F.when(s.endswith("left"), "L").when(s.endswith("right"), "R")
    return (
        iv.filter(s.startswith(prefix))
        .select(*keys, F.col("b").alias("t"), side.alias("side"))
        .filter(F.col("side").isNotNull())
    )


def overtime_spans(
    iv: DataFrame,
    keys: Sequence[str],
    status: str,
    min_us: int,
    tick: int,
    layout: Layout | None = None,
) -> DataFrame:
    """Stretches of one status after the duration filter, with an exclusive end."""
    kept = filter_min_duration(iv, keys, min_us, layout=layout)
    return kept.filter(F.col("status") == status).withColumn("e", F.col("e") + tick)


def deaths(
    alive_iv: DataFrame,
    hero_iv: DataFrame,
    keys: Sequence[str],
    delay: int = 300_000,
    dead: str = "dead",
    layout: Layout | None = None,
) -> DataFrame:
    """A death a moment after each dead stretch begins, with the hero played at its begin."""
    d = alive_iv.filter(F.col("status") == dead).select(*keys, F.col("b").alias("t"))
    d = state_at(d, hero_iv, keys, "t", out="hero", layout=layout)
    return d.withColumn("t", F.col("t") + delay)


def revives(
    alive_iv: DataFrame,
    keys: Sequence[str],
    max_us: int = 9_800_000,
    dead: str = "dead",
    layout: Layout | None = None,
) -> DataFrame:
    """Ends of dead stretches that are short and not the last interval."""
    df = scan(alive_iv, keys, ORDER, {"_n": Next(F.lit(1))}, layout)
    return df.filter(
        (F.col("status") == dead)
        & (F.col("e") - F.col("b") <= max_us)
        & F.col("_n").isNotNull()
    ).select(*keys, F.col("e").alias("t"))


def switches(
    hero_iv: DataFrame,
    blocked: DataFrame,
    keys: Sequence[str],
    max_gap: int = 5_000_000,
    tick: int = 100_000,
    layout: Layout | None = None,
) -> DataFrame:
    """Changes of hero: begins snapped to the end before, stretches wholly inside a dead or
    abnormal one left out, repeats of the hero before dropped."""
    snapped = scan(hero_iv, keys, ORDER, {"_pe": Prev("e")}, layout)
    near = F.col("_pe").isNotNull() & (F.col("b") - F.col("_pe") < max_gap)
    snapped = snapped.withColumn(
        "begin", F.when(near, F.col("_pe") + tick).otherwise(F.col("b"))
    ).drop("_pe")
    free = not_within(snapped, blocked, keys, layout)
    free = scan(free, keys, ORDER, {"_p": Prev("status")}, layout)
    return free.filter(~F.col("status").eqNullSafe(F.col("_p"))).select(
        *keys, F.col("begin").alias("b"), "e", F.col("status").alias("hero")
    )


def lifecycle(
    iv: DataFrame,
    keys: Sequence[str],
    roles: tuple[str, str, str],
    hero_iv: DataFrame | None = None,
    sequences: DataFrame | None = None,
    special: str | None = None,
    alive_iv: DataFrame | None = None,
    max_gap: int = 3_000_000,
    tick: int = 100_000,
    same_hero_after: int = 2_000_000,
    near_start: int = 1_000_000,
    long_after: int = 10_000_000,
    layout: Layout | None = None,
) -> DataFrame:
    """Gained, used and ended times of a charge seen as ``no -> has -> using`` states.

    ``roles`` names the three states.  ``has`` followed by ``using`` is used at its
    end.  ``has`` followed by ``no`` is taken as used unseen where the hero (not
    ``special``) is the same ``same_hero_after`` later and either a sequence starts
    within ``near_start`` before that ``no``, or it lasts longer than
    ``long_after``.  ``using`` right after ``no`` gives an inferred gain.  With
    ``special`` repeats of that hero's charge are suppressed
    (:func:`suppress_repeats`).
    """
    layout = layout or Layout.inspect(iv, keys)
    no, has, using = roles
    df = scan(
        iv,
        keys,
        ORDER,
        {
            "_ps": Prev("status"),
            "_pe": Prev("e"),
            "_ns": Next("status"),
            "_nb": Next("b"),
            "_ne": Next("e"),
        },
        layout,
    )
    s, b, e = F.col("status"), F.col("b"), F.col("e")
    after_no = F.coalesce(F.col("_ps") == no, F.lit(False))
    close = after_no & (b - F.col("_pe") < max_gap)
    df = df.filter((s == has) | ((s == using) & after_no))
    df = df.withColumn(
        "gained",
        F.when(close, F.col("_pe") + tick).when(s == using, b - tick).otherwise(b),
    )
    unseen = (s == has) & (F.col("_ns") == no)
    hidden_used = F.lit(None).cast("bigint")
    hidden_end = F.col("_nb") + tick
    if hero_iv is None:
        same = F.lit(True)
    else:
        df = state_at(df, hero_iv, keys, "e", out="_hero", layout=layout)
        later = df.withColumn("_later", e + same_hero_after)
        df = state_at(later, hero_iv, keys, "_later", out="_hero2", layout=layout)
        same = F.coalesce(F.col("_hero") == F.col("_hero2"), F.lit(False))
        if special is not None:
            same = same & (F.col("_hero") != special)
    long = F.col("_ne") - F.col("_nb") > long_after
    if sequences is None:
        hidden_used = F.when(unseen & same & long, e + tick)
    else:
        from spanline.ordered import nearest_rows

        starts = sequences.select(*keys, F.col("b").alias("_sb"))
        df = df.withColumn("_probe", F.coalesce("_nb", "e"))
        df = nearest_rows(df, starts, keys, "_probe", "_sb", before="_st", layout=layout)
        at_start = F.coalesce(F.col("_nb") - F.col("_st._sb") < near_start, F.lit(False))
        hidden_used = F.when(
            unseen & same & at_start, F.col("_nb") - near_start
        ).when(unseen & same & long, e + tick)
    used = (
        F.when((s == has) & (F.col("_ns") == using), e + tick)
        .when(s == using, b)
        .otherwise(hidden_used)
    )
    ended = (
        F.when((s == has) & (F.col("_ns") == using), F.col("_ne") + tick)
        .when(s == using, e + tick)
        .otherwise(F.when(hidden_used.isNotNull(), hidden_end))
    )
    out = df.select(*keys, "gained", used.alias("used"), ended.alias("ended"))
    if special is None or hero_iv is None:
        return out
    return suppress_repeats(out, hero_iv, alive_iv, keys, special, layout)


def suppress_repeats(
    ults: DataFrame,
    hero_iv: DataFrame,
    alive_iv: DataFrame | None,
    keys: Sequence[str],
    special: str,
    layout: Layout | None = None,
    quick: int = 2_000_000,
    dead_before: int = 500_000,
    alive: str = "alive",
) -> DataFrame:
    """Drop or merge repeated charges of one hero.

    Such a charge is dropped where it is used within ``quick`` of a gain that came
    while not alive, or gained within ``quick`` of the end of the kept one before;
    it completes that one if it was left unused by the same hero.  Charges that
    surely open afresh (another hero's, or unused ones gained after everything
    before has ended) cut the timeline into episodes for the fold.
    """
    keys = list(keys)
    layout = layout or Layout.inspect(ults, keys)
    df = state_at(ults, hero_iv, keys, "gained", out="_hero", layout=layout)
    df = df.withColumn("_special", F.coalesce(F.col("_hero") == special, F.lit(False)))
    df = df.withColumn("_probe", F.coalesce("used", "gained"))
    df = state_at(df, hero_iv, keys, "_probe", out="_used_hero", layout=layout)
    if alive_iv is not None:
        df = df.withColumn("_probe", F.col("gained") - dead_before)
        df = state_at(df, alive_iv, keys, "_probe", out="_alive", layout=layout)
        df = df.withColumn("_was_alive", F.coalesce(F.col("_alive") == alive, F.lit(False)))
    else:
        df = df.withColumn("_was_alive", F.lit(True))
    order = ["gained"]
    df = scan(df, keys, order, {"_until": MaxBefore("ended")}, layout, True)
    afresh = ~F.col("_special") | (
        F.col("used").isNull()
        & (F.col("_until").isNull() | (F.col("_until") <= F.col("gained") - quick))
    )
    df = df.withColumn("_afresh", afresh.cast("bigint"))
    df = scan(df, keys, order, {"_episode": RunSum("_afresh")}, layout)
    df = df.withColumn("_has_used_hero", F.col("_used_hero").isNotNull())
    needed = [
        *keys, "_episode", "gained", "used", "ended", "_special", "_was_alive", "_has_used_hero",
    ]

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        last: dict | None = None
        for r in rows:
            gained, used, ended = r["gained"], r["used"], r["ended"]
            if last and r["_special"]:
                if used is not None and used - gained < quick and not r["_was_alive"]:
                    continue
                if last["ended"] is not None and gained - quick < last["ended"]:
                    continue
                if (
                    last["used"] is None
                    and used is not None
                    and last["_special"]
                    and r["_has_used_hero"]
                ):
                    last.update(used=used, ended=ended)
                    continue
            if last:
                yield last
            last = dict(r)
        if last:
            yield last

    schema = ", ".join(
        [f"{c} {ults.schema[c].dataType.simpleString()}" for c in [*keys, "gained", "used", "ended"]]
    )
    return timeline_fold(df.select(*needed), [*keys, "_episode"], order, fold, schema, F.lit(True))


def effects(
    iv: DataFrame,
    hero_iv: DataFrame,
    rules: DataFrame,
    keys: Sequence[str],
    caps: Mapping[str, tuple[int, int]],
    tick: int,
    normal: str = "normal",
    layout: Layout | None = None,
    alive: DataFrame | None = None,
    alive_rules: DataFrame | None = None,
) -> DataFrame:
    """Effects with a present cause: begins snapped to the end before, too long ones cut to
    the given length, ends exclusive.  ``caps``: ``effect -> (longest, length instead)``.
    With ``alive (keys, side, slot, b, e)`` and ``alive_rules (effect, lead_us)`` the victim of
    such an effect must have lived ``lead_us`` before it began."""
    slot_keys = [*keys, "side", "slot"]
    seen = snap_begin(
        iv.withColumn("_cause_b", F.col("b")), slot_keys, None, tick, layout
    ).filter((F.col("status") != normal) & ~F.col("status").startswith("not_"))
    end = F.col("e")
    for effect, (longest, instead) in caps.items():
        too_long = (F.col("status") == effect) & (F.col("e") - F.col("_cause_b") > longest)
        end = F.when(too_long, F.col("_cause_b") + instead).otherwise(end)
    seen = seen.withColumn("e", end)
    # causes are judged at the begin as observed, before snapping
    judged = seen.withColumn("_snapped", F.col("b")).withColumn("b", F.col("_cause_b"))
    kept = require_cause(judged, hero_iv, rules, keys, layout=layout)
    if alive is not None and alive_rules is not None:
        kept = require_alive(kept, alive, alive_rules, slot_keys, layout=layout)
    return kept.select(
        *slot_keys, F.col("_snapped").alias("b"), (F.col("e") + tick).alias("e"), "status"
    )
