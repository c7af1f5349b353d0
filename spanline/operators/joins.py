"""Temporal joins without pair generation.

A join of points with a timeline is an as-of lookup: union both sides, sort once
by ``(keys, time)``, carry the wanted row along (:func:`spanline.ordered.nearest_rows`).
It is linear in both sides whatever the overlap, and a hot key is split by the
scan.  Joins on plain keys are left to Catalyst and AQE, which broadcast a side
only after looking at its size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.ordered import (
    LastValue,
    Layout,
    Next,
    NextValue,
    Prev,
    RunSum,
    Step,
    nearest_rows,
    scan,
)
from spanline.session import cut_lineage


def state_at(
    points: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    closed: str = "both",
    out: str = "status",
    layout: Layout | None = None,
) -> DataFrame:
    """Status of the first interval containing ``t``; NULL in gaps.

    ``closed='both'`` is ``[b, e]``, ``'left'`` is ``[b, e)``.  The intervals of a
    key are a timeline: ordered, not overlapping (ends may touch begins).
    """
    table = iv.select(*keys, "b", "e", F.col("status").alias("_s"))
    hit = nearest_rows(
        points, table, keys, t, "e", after="_iv", table_first=closed == "left", tie="b",
        layout=layout,
    )
    inside = F.col("_iv.b") <= F.col(t)
    return hit.withColumn(out, F.when(inside, F.col("_iv._s"))).drop("_iv")


def covered_until(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    layout: Layout | None = None,
) -> DataFrame:
    """Add ``_until``: the latest end of any range that begins at or before ``t``."""
    return nearest_rows(
        points, ranges.select(*keys, "b", "e"), keys, t, "b",
        highest={"_until": lambda r: r["e"]}, layout=layout,
    )


def in_any_range(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    layout: Layout | None = None,
) -> DataFrame:
    """Points inside at least one closed range; ranges may overlap."""
    df = covered_until(points, ranges, keys, t, layout)
    return df.filter(F.col("_until") >= F.col(t)).drop("_until")


def has_state_at(
    points: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    status: str = "status",
    layout: Layout | None = None,
) -> DataFrame:
    """Points whose group has some timeline in state ``points.status`` at ``t``.

    The status is part of the key, so overlapping timelines of one group are fine.
    """
    ranges = iv.select(*keys, F.col("status").alias(status), "b", "e")
    return in_any_range(points, ranges, [*keys, status], t, layout)


def asof_forward(
    points: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    out: str = "status",
    layout: Layout | None = None,
) -> DataFrame:
    """Status of the first interval ending strictly after ``t``; past the end, of the last."""
    table = iv.select(*keys, "b", "e", F.col("status").alias("_s"))
    hit = nearest_rows(
        points, table, keys, t, "e", before="_prev", after="_iv", tie="b", layout=layout
    )
    # past the last end, the row before is the last
    return hit.withColumn(out, F.coalesce("_iv", "_prev")["_s"]).drop("_iv", "_prev")


def interval_lookup_default(
    points: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    default: str | None = None,
    out: str = "status",
    layout: Layout | None = None,
) -> DataFrame:
    """Status in ``[b, e)``; elsewhere ``default``, or the group's last status if None."""
    if default is not None:
        hit = state_at(points, iv, keys, t, "left", "_hit", layout)
        return hit.withColumn(out, F.coalesce("_hit", F.lit(default))).drop("_hit")
    table = iv.select(*keys, "b", "e", F.col("status").alias("_s"))
    hit = nearest_rows(
        points, table, keys, t, "e", after="_iv", tie="b",
        whole={"_last": lambda r: F.struct(r["b"], r["e"], r["_s"].alias("_s"))}, layout=layout,
    )
    inside = F.when(F.col("_iv.b") <= F.col(t), F.col("_iv._s"))
    return hit.withColumn(out, F.coalesce(inside, F.col("_last._s"))).drop("_iv", "_last")


def label_grid(
    grid: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    attrs: Sequence[str],
    t: str = "t",
    defaults: Mapping[str, str] | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """One label per grid point and attribute; an empty timeline gives the defaults.

    ``iv`` has an ``attr`` column.  A label is that of the first interval ending after the
    point, past the end that of the last (:func:`asof_forward`).  Points and the intervals of
    all attributes meet in one pass per direction; a point repeated counts once.
    """
    keys = list(keys)
    points = grid.select(
        *keys, F.col(t).alias("_at"), F.lit(1).alias("_tag"),
        F.lit(None).cast(iv.schema["b"].dataType).alias("_tie"),
    )
    ends = iv.filter(F.col("attr").isin(*attrs)).select(
        *keys, F.col("e").alias("_at"), F.lit(0).alias("_tag"), F.col("b").alias("_tie"),
        F.col("attr").alias("_attr"), F.struct(F.col("status").alias("s")).alias("_row"),
    )
    steps: dict[str, Step] = {"_before": Prev(F.struct("_tag", "_at"))}
    for i, a in enumerate(attrs):
        own = F.when(F.col("_attr") == a, F.col("_row"))
        steps |= {f"_prev{i}": LastValue(own), f"_next{i}": NextValue(own)}
    rows = points.unionByName(ends, allowMissingColumns=True)
    done = scan(rows, keys, ["_at", "_tag", "_tie"], steps, layout)
    # points of one time follow each other
    first = ~F.col("_before").eqNullSafe(F.struct("_tag", "_at"))
    labels = [
        F.coalesce(
            F.coalesce(f"_next{i}", f"_prev{i}")["s"], F.lit((defaults or {}).get(a, "n/a"))
        ).alias(a)
        for i, a in enumerate(attrs)
    ]
    return done.filter((F.col("_tag") == 1) & first).select(*keys, F.col("_at").alias(t), *labels)


def exclude_boundary(
    points: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    layout: Layout | None = None,
) -> DataFrame:
    """Drop samples exactly on an interval begin; those without a key or a time stay."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    begins = iv.select(*keys, "b").filter(known & F.col("b").isNotNull())
    hit = nearest_rows(points, begins, keys, t, "b", before="_begin", layout=layout)
    on = F.coalesce(F.col("_begin.b") == F.col(t), F.lit(False))
    return hit.filter(~on).select(*points.columns)


def exclude_transition_zone(
    points: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    guard: int,
    t: str = "t",
    layout: Layout | None = None,
) -> DataFrame:
    """Drop samples near interval edges; flag those in the shrunken interior as ``inside``.

    Edges are ``[b, b + guard)`` and ``[e - guard, e]``; the interior is
    ``[b + guard, e - guard)``.
    """
    g, tick = F.lit(guard), F.lit(1)
    pieces = F.array(
        F.struct(F.col("b").alias("b"), (F.col("b") + g - tick).alias("e"), F.lit(True).alias("edge")),
        F.struct((F.col("e") - g).alias("b"), F.col("e").alias("e"), F.lit(True).alias("edge")),
        F.struct(
            (F.col("b") + g).alias("b"), (F.col("e") - g - tick).alias("e"), F.lit(False).alias("edge")
        ),
    )
    zones = iv.select(*keys, F.explode(pieces).alias("_z")).select(*keys, "_z.b", "_z.e", "_z.edge")
    looked = nearest_rows(
        points,
        zones.filter(F.col("e") >= F.col("b")),
        keys,
        t,
        "b",
        highest={
            "_edge": lambda r: F.when(r["edge"], r["e"]),
            "_inner": lambda r: F.when(~r["edge"], r["e"]),
        },
        layout=layout,
    )
    kept = looked.filter(F.col("_edge").isNull() | (F.col("_edge") < F.col(t)))
    return kept.withColumn(
        "inside", F.coalesce(F.col("_inner") >= F.col(t), F.lit(False))
    ).drop("_edge", "_inner")


def not_within(
    iv: DataFrame,
    outer: DataFrame,
    keys: Sequence[str],
    layout: Layout | None = None,
) -> DataFrame:
    """Intervals not wholly inside any ``outer`` interval of their group."""
    df = covered_until(iv, outer, keys, "b", layout)
    return df.filter(F.col("_until").isNull() | (F.col("_until") < F.col("e"))).drop("_until")


def nearest_event(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    max_us: int = 7_000_000,
    tie: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """For each left row the nearest right row in time, as struct ``match``.

    Equal distances give the earlier row, rows at one time the lowest ``tie``.
    ``match`` is NULL beyond ``max_us`` (exactly ``max_us`` is accepted).
    """
    others = [c for c in right.columns if c not in keys]
    ranked = F.struct(F.col(tie)) if tie else F.struct(*others)
    first = right.groupBy(*keys, F.col(t).alias("_rt")).agg(
        F.min_by(F.struct(*others), ranked).alias("_r")
    )
    hit = nearest_rows(
        left, first, keys, t, "_rt", before="_b", after="_a", layout=layout
    )
    back = F.col(t) - F.col("_b._rt")
    ahead = F.col("_a._rt") - F.col(t)
    use_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    best = F.when(use_back, F.col("_b._r")).otherwise(F.col("_a._r"))
    dist = F.when(use_back, back).otherwise(ahead)
    return hit.withColumn("match", F.when(dist <= max_us, best)).drop("_b", "_a")


def nearest_or_default(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str,
    max_us: int,
    default: Mapping[str, str],
    tie: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """:func:`nearest_event` with a stand-in for unmatched rows; time is the earlier of both."""
    df = nearest_event(left, right, keys, t, max_us, tie, layout)
    m = F.col("match")
    out = {c: F.coalesce(m[c].cast("string"), F.lit(v)) for c, v in default.items()}
    out["event_t"] = F.least(F.col(t), m[t])
    out["matched"] = m.isNotNull()
    return df.withColumns(out).drop("match")


def overlap_duration(
    iv: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    range_id: str,
    ignore: str = "n/a",
    layout: Layout | None = None,
) -> DataFrame:
    """Full length (``dur``) of the intervals starting inside each range, per status, and when
    the status was first ``seen``.

    A range in which none starts takes the interval that covers its begin.  Both
    sides are disjoint within a key, so every interval has at most one range to
    start in and every range one interval to fall back on: two lookups, no pairs.
    """
    known = iv.filter(F.col("status") != ignore).select(*keys, "b", "e", "status")
    r = ranges.select(*keys, F.col(range_id), "b", "e")
    started = nearest_rows(known, r, keys, "b", "b", before="_r", layout=layout)
    inside = started.filter(F.col("b") <= F.col("_r.e")).select(
        *keys,
        F.col("_r")[range_id].alias(range_id),
        "status",
        (F.col("e") - F.col("b")).alias("dur"),
        F.col("b").alias("seen"),
    )
    inside = inside.groupBy(*keys, range_id, "status").agg(
        F.sum("dur").alias("dur"), F.min("seen").alias("seen")
    )
    before = nearest_rows(
        r, known, keys, "b", "b", before="_i", table_first=False, layout=layout
    )
    fallback = before.filter(F.col("_i.e") > F.col("b")).select(
        *keys,
        range_id,
        F.col("_i.status").alias("status"),
        (F.col("_i.e") - F.col("_i.b")).alias("dur"),
        F.col("_i.b").alias("seen"),
    )
    both = inside.withColumn("_own", F.lit(1)).unionByName(fallback.withColumn("_own", F.lit(0)))
    # a range has at most one row per status of the vocabulary plus its fallback
    w = Window.partitionBy(*keys, range_id)
    return (
        both.withColumn("_best", F.max("_own").over(w))
        .filter(F.col("_own") == F.col("_best"))
        .drop("_own", "_best")
    )


def valid_at(
    df: DataFrame,
    versions: DataFrame,
    date: str,
    name: str = "version",
) -> DataFrame:
    """Version valid on a date (``begin <= date < end``) and the share of it elapsed.

    Versions follow each other; one without end is open (its share is NULL), one of no
    length is void.  The lookup is made for each distinct day, of which there are few
    however many rows there are; a date outside all versions keeps NULLs.
    """
    day = F.col(date).cast("date")
    days = df.select(day.alias("_day")).filter("_day is not null").distinct()
    live = versions.filter(F.col("end").isNull() | (F.col("begin") < F.col("end"))).select(
        name, F.col("begin").cast("date").alias("_vb"), F.col("end").cast("date").alias("_ve")
    )
    found = nearest_rows(days, live, [], "_day", "_vb", before="_v", layout=Layout(False))
    open_still = F.col("_v._ve").isNull() | (F.col("_day") < F.col("_v._ve"))
    hit = found.select("_day", F.when(open_still, F.col("_v")).alias("_v"))
    progress = F.datediff("_day", F.col("_v._vb")) / F.datediff(F.col("_v._ve"), F.col("_v._vb"))
    return (
        df.join(hit, day == F.col("_day"), "left")
        .withColumns({name: F.col("_v")[name], "progress": progress})
        .drop("_day", "_v")
    )


def dim_join(df: DataFrame, dims: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Look up ``value`` by ``key``; names are lower-cased, a later table overrides earlier ones."""
    ranked = None
    for i, dim in enumerate(dims):
        part = dim.select(key, F.lower(F.col(value)).alias(value), F.lit(i).alias("_src"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(key).agg(F.max_by(value, F.struct("_src", value)).alias(value))
    return df.join(best, key, "left")


def skip_processed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the already processed set."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def missing_report(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` without a row in ``other``, and how many there are."""
    gone = df.join(other.select(key).distinct(), key, "left_anti").select(key).distinct()
    return gone.agg(
        F.count(F.lit(1)).alias("n_missing"),
        F.min(key).alias("first_missing"),
        F.max(key).alias("last_missing"),
    )


def relaxed_match(
    left: DataFrame,
    right: DataFrame,
    fields: Sequence[str],
    prefixes: Sequence[int],
    left_id: str,
    right_ord: str,
    flag: str | None = None,
) -> DataFrame:
    """Best right row per left row, matching ever fewer leading fields.

    An index holds, for each level, the first right row (lowest ``right_ord``) of every
    prefix.  The distinct field combinations of the left side, far fewer than its rows, look
    up all their prefixes in it by one join; the longest prefix found wins.  The left
    side itself is joined once, to the result of its combination, so a prefix that a third
    of all rows share is looked up once for each of its combinations.  ``flag`` must agree at
    every level; null fields agree with null ones.  Prefixes are told apart by 128 bits.
    """
    always = [flag] if flag else []
    every = [*fields[: max(prefixes)], *always]

    def key(df: DataFrame, level: int, cols: Sequence[str]) -> list[Column]:
        parts = [F.lit(level)]
        for c in cols:
            parts += [df[c].isNull(), df[c]]
        return [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]

    def exploded(df: DataFrame, rest: list[str]) -> DataFrame:
        keys = []
        for level, n in enumerate(prefixes):
            hashes = [h.alias(f"h{k}") for k, h in enumerate(key(df, level, [*fields[:n], *always]))]
            keys.append(F.struct(F.lit(level).alias("level"), *hashes))
        return df.select(*rest, F.explode(F.array(*keys)).alias("_p")).select(*rest, "_p.*")

    index = (
        exploded(right.select(*every, F.col(right_ord).alias("_ord")), ["_ord"])
        .groupBy("h0", "h1")
        .agg(F.min("_ord").alias("_ord"))
        .filter("_ord is not null")
    )
    combos = left.select(*every).distinct()
    whole = key(combos, -1, every)
    asked = exploded(combos.select(*every, whole[0].alias("_c0"), whole[1].alias("_c1")), ["_c0", "_c1"])
    best = (
        asked.join(index, ["h0", "h1"])
        .groupBy("_c0", "_c1")
        .agg(F.min(F.struct("level", "_ord")).alias("_best"))
        .select("_c0", "_c1", "_best")
    )
    own = key(left, -1, every)
    sizes = F.array(*[F.lit(n) for n in prefixes])
    return (
        left.join(best, (own[0] == F.col("_c0")) & (own[1] == F.col("_c1")), "left")
        .withColumn("matched_ord", F.col("_best._ord"))
        .withColumn("matched_fields", F.get(sizes, F.col("_best.level")))
        .drop("_c0", "_c1", "_best")
    )


def require_cause(
    effects: DataFrame,
    iv: DataFrame,
    rules: DataFrame,
    keys: Sequence[str],
    side: str = "side",
    effect: str = "status",
    lead_us: str = "lead_us",
    layout: Layout | None = None,
    slot: str = "slot",
) -> DataFrame:
    """Effects whose cause was present when they began; effects without a rule stay.

    ``rules``: ``(effect, relation, cause, lead_us)`` with relation ``enemy``,
    ``friendly`` or ``own``; any one cause of an effect is enough.  ``lead_us`` looks that
    much before the begin.  ``own`` looks at the victim's ``slot`` alone, in ``iv`` rows of
    the same slot; where ``iv`` has no slots it never holds.
    """
    other = F.when(F.col(side) == "left", "right").otherwise("left")
    rows = effects.withColumn("_eid", F.struct(*effects.columns))
    own = slot in effects.columns and slot in iv.columns
    whose = F.concat(F.lit("s"), F.col(slot).cast("string")) if own else F.lit("")
    wanted = rows.join(
        rules.select(
            F.col("effect").alias(effect), "relation", "cause", F.col(lead_us).alias("_lead")
        ),
        effect,
    )
    if not own:
        wanted = wanted.filter("relation <> 'own'")
    wanted = wanted.select(
        *keys,
        F.when(F.col("relation") == "enemy", other).otherwise(F.col(side)).alias("_side"),
        F.when(F.col("relation") == "own", whose).otherwise("").alias("_slot"),
        F.col("cause").alias("_cause"),
        (F.col("b") - F.col("_lead")).alias("_t"),
        "_eid",
    )
    who = [F.col(side).alias("_side"), F.lit("").alias("_slot")]
    present = iv.select(*keys, *who, F.col("status").alias("_cause"), "b", "e")
    if own:
        causes = rules.filter("relation = 'own'").select(F.col("cause").alias("_cause")).distinct()
        mine = iv.select(
            *keys, F.col(side).alias("_side"), whose.alias("_slot"), F.col("status").alias("_cause"), "b", "e"
        )
        present = present.unionByName(mine.join(causes, "_cause", "left_semi"))
    caused = in_any_range(wanted, present, [*keys, "_side", "_slot", "_cause"], "_t", layout)
    named = rules.select(F.col("effect").alias(effect)).distinct()
    free = effects.join(named, effect, "left_anti").select(*effects.columns)
    ruled = caused.select("_eid").distinct().select("_eid.*")
    return ruled.unionByName(free)


def require_alive(
    effects: DataFrame,
    alive: DataFrame,
    rules: DataFrame,
    keys: Sequence[str],
    effect: str = "status",
    layout: Layout | None = None,
) -> DataFrame:
    """Effects whose victim lived when they began, or shortly before; others than those of a rule stay.

    ``alive (keys, b, e)`` holds living stretches, ``keys`` name a victim, ``rules`` is
    ``(effect, lead_us)``; of several rules of an effect any one is enough.
    """
    named = rules.select(F.col("effect").alias(effect), F.col("lead_us").alias("_lead"))
    asked = effects.withColumn("_eid", F.struct(*effects.columns)).join(named, effect)
    asked = asked.select(*keys, (F.col("b") - F.col("_lead")).alias("_t"), "_eid")
    lived = in_any_range(asked, alive.select(*keys, "b", "e"), keys, "_t", layout)
    free = effects.join(named.select(effect).distinct(), effect, "left_anti").select(*effects.columns)
    return lived.select("_eid").distinct().select("_eid.*").unionByName(free)


def _reach_of(name: str):
    return lambda row: F.when(row["name"] == name, row["e"])


def eligibility_mask(
    scores: DataFrame,
    ranges: DataFrame,
    rules: Mapping[int, str],
    keys: Sequence[str],
    t: str = "t",
    scores_col: str = "scores",
    layout: Layout | None = None,
) -> DataFrame:
    """Scores with an entry at minus infinity where no range of its rule covers ``t``.

    ``rules`` maps a score position to the range name (column ``name`` of
    ``ranges``) that allows it.  One pass answers all names.
    """
    names = sorted(set(rules.values()))
    looked = nearest_rows(
        scores,
        ranges.filter(F.col("name").isin(*names)).select(*keys, "name", "b", "e"),
        keys,
        t,
        "b",
        highest={f"_until{i}": _reach_of(name) for i, name in enumerate(names)},
        layout=layout,
    )
    masked = looked.withColumns(
        {
            f"_ok{i}": F.coalesce(F.col(f"_until{i}") >= F.col(t), F.lit(False))
            for i in range(len(names))
        }
    ).drop(*[f"_until{i}" for i in range(len(names))])
    col = F.col(scores_col)
    blocked = F.array(
        *[
            F.when(~F.col(f"_ok{names.index(name)}"), F.lit(pos)).otherwise(F.lit(-1))
            for pos, name in rules.items()
        ]
    )
    new = F.transform(
        col,
        lambda x, i: F.when(F.array_contains(blocked, i), F.lit(float("-inf"))).otherwise(
            x.cast("double")
        ),
    )
    return masked.withColumn(scores_col, new).drop(*[f"_ok{i}" for i in range(len(names))])


def deletions(text: Column, n: int) -> Column:
    """All strings left when up to ``n`` characters are taken out, each once."""
    out = F.array(text)
    for _ in range(n):
        shorter = F.transform(
            out,
            lambda x: F.transform(
                F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))),
                lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))),
            ),
        )
        out = F.array_distinct(F.concat(out, F.flatten(shorter)))
    return out


#: Longest names whose deletions of one and of two characters are listed.
DELETION_LIMITS = {1: 200, 2: 40}


def nearest_name(
    names: DataFrame,
    roster: DataFrame,
    name: str,
    roster_name: str,
    block: int = 512,
) -> DataFrame:
    """Closest roster name by edit distance (ties: lowest in order) for every name.

    Two strings within ``d`` edits have a string in common among those left after up to
    ``d`` deletions from each.  Distinct names meet the roster by an equi join on such
    strings, first for one edit, then, those without a hit, for two; hits are measured.
    Names further off are measured against the whole roster, in blocks of about ``block``
    names; there is no limit on the roster.  Names without any roster name are left out.
    """
    # names repeat in observations: each distinct one is looked up once
    left = cut_lineage(names.select(F.col(name).alias("_name")).filter("_name is not null").distinct())
    entries = cut_lineage(roster.select(F.col(roster_name).alias("_entry")).filter("_entry is not null").distinct())
    least = F.min(F.struct(F.levenshtein("_name", "_entry").alias("d"), F.col("_entry").alias("n"))).alias("_best")
    found = []
    for n, limit in DELETION_LIMITS.items():
        short = lambda c: F.col(c).isNotNull() & (F.char_length(c) <= limit)  # noqa: B023, E731
        ours = left.filter(short("_name")).select("_name", F.explode(deletions(F.col("_name"), n)).alias("_left"))
        theirs = entries.filter(F.char_length("_entry") <= limit + n).select(
            "_entry", F.explode(deletions(F.col("_entry"), n)).alias("_left")
        )
        near = ours.join(theirs, "_left").filter(F.levenshtein("_name", "_entry") <= n)
        hits = cut_lineage(near.groupBy("_name").agg(least))
        found.append(hits)
        left = cut_lineage(left.join(hits.select(F.col("_name").alias("_hit")), F.col("_name") == F.col("_hit"), "left_anti"))
    blocks = max(1, ceil(entries.count() / block))
    part = F.pmod(F.xxhash64("_entry"), F.lit(blocks))
    packed = entries.groupBy(part.alias("_block")).agg(F.collect_list("_entry").alias("_entries"))
    far = left.withColumn("_block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).join(packed, "_block")
    closest = F.array_min(
        F.transform("_entries", lambda r: F.struct(F.levenshtein(F.col("_name"), r).alias("d"), r.alias("n")))
    )
    best = far.select("_name", closest.alias("_b")).groupBy("_name").agg(F.min("_b").alias("_best"))
    for hits in found:
        best = best.unionByName(hits)
    return (
        names.join(best, F.col(name) == F.col("_name"))
        .withColumn("best_name", F.col("_best.n"))
        .withColumn("best_distance", F.col("_best.d"))
        .drop("_best", "_name")
    )


def fuzzy_assign(
    names: DataFrame,
    roster: DataFrame,
    keys: Sequence[str],
    slot: str = "slot",
    name: str = "name",
    roster_name: str = "name",
    max_roster: int = 1_000,
    layout: Layout | None = None,
) -> DataFrame:
    """Give each name of a group the closest roster name not yet taken, in slot order.

    Exact matches take their roster name first.  A group's roster is an array of a
    few names (refused above ``max_roster``); once it is used up later names stay as
    they are, so only the first ``size(roster)`` open names of a group enter the fold.
    """
    keys = list(keys)
    biggest = Layout.largest(roster, keys)
    if biggest > max_roster:
        raise ValueError(f"a roster of {biggest} names")
    teams = roster.groupBy(*keys).agg(F.array_sort(F.collect_set(roster_name)).alias("_roster"))
    df = names.join(teams, keys, "left").withColumn(
        "_roster", F.coalesce("_roster", F.array().cast("array<string>"))
    )
    exact = F.array_contains("_roster", F.col(name))
    df = df.withColumn("_exact", exact)
    df = scan(df, keys, [slot], {"_turn": RunSum((~F.col("_exact")).cast("bigint"))}, layout)
    df = df.withColumn(
        "_folds", ~F.col("_exact") & (F.col("_turn") <= F.size("_roster"))
    )
    taken = df.filter("_exact").groupBy(*keys).agg(F.collect_set(name).alias("_taken"))
    pending = df.filter("_folds").groupBy(*keys, "_roster").agg(
        F.array_sort(F.collect_list(F.struct(F.col(slot), F.col(name)))).alias("_todo")
    )
    start = pending.join(taken, keys, "left").withColumn(
        "_left", F.array_except("_roster", F.coalesce("_taken", F.array().cast("array<string>")))
    )

    def step(acc, item):
        pick = F.array_min(
            F.transform(
                acc["left"],
                lambda r: F.struct(
                    F.levenshtein(item[name], r).alias("d"), r.alias("n")
                ),
            )
        )["n"]
        chosen = F.coalesce(pick, item[name])
        return F.struct(
            F.array_remove(acc["left"], chosen).alias("left"),
            F.concat(
                acc["done"],
                F.array(F.struct(item[slot].alias("slot"), chosen.alias("assigned"))),
            ).alias("done"),
        )

    slot_type = names.schema[slot].dataType.simpleString()
    zero = F.struct(
        F.col("_left").alias("left"),
        F.array().cast(f"array<struct<slot:{slot_type},assigned:string>>").alias("done"),
    )
    done = start.select(
        *keys, F.explode(F.aggregate("_todo", zero, step)["done"]).alias("_d")
    ).select(*keys, F.col("_d.slot").alias(slot), F.col("_d.assigned").alias("_assigned"))
    return (
        df.join(done, [*keys, slot], "left")
        .withColumn("assigned", F.coalesce("_assigned", F.col(name)))
        .select(*names.columns, "assigned")
    )


def lookahead_pending(
    points: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    admit: int = 200_000,
    horizon: int = 500_000,
    tie: str = "event_id",
    layout: Layout | None = None,
) -> DataFrame:
    """How many events just after ``t`` are already visible as pending entries.

    Of the events in ``(t, t + horizon]`` those up to ``t + admit`` count, unless
    another one lies within ``admit`` and no third one lies within ``admit`` of it.
    That rule only needs the next three events and the number up to ``t + admit``:
    with ``x1 <= x2 <= x3`` the first is admitted if ``x2`` is not near it or ``x3``
    is near ``x2``, the second if ``x3`` is near ``x1``, all later ones always.
    """
    ev = events.select(*keys, F.col(t).alias("_t"), F.col(tie).alias("_id"))
    ev = scan(ev, keys, ["_t", "_id"], {"_n": RunSum(F.lit(1)), "_x2": Next("_t")}, layout, True)
    ev = scan(ev, keys, ["_t", "_id"], {"_x3": Next("_x2")}, layout)
    df = nearest_rows(points, ev, keys, t, "_t", after="_x", tie="_id", layout=layout)
    stop = df.withColumn("_stop", F.col(t) + admit)
    upto = nearest_rows(stop, ev, keys, "_stop", "_t", before="_l", tie="_id", layout=layout)
    x1 = F.col("_x._t")
    x2 = F.when(F.col("_x._x2") <= F.col(t) + horizon, F.col("_x._x2"))
    x3 = F.when(F.col("_x._x3") <= F.col(t) + horizon, F.col("_x._x3"))
    n = F.coalesce(F.col("_l._n") - F.col("_x._n") + 1, F.lit(0))
    n = F.when(x1 <= F.col(t) + admit, n).otherwise(F.lit(0))
    near12 = F.coalesce(x2 - x1 <= admit, F.lit(False))
    near23 = F.coalesce(x3 - x2 <= admit, F.lit(False))
    near13 = F.coalesce(x3 - x1 <= admit, F.lit(False))
    first = ((n >= 1) & (~near12 | near23)).cast("bigint")
    second = ((n >= 2) & near13).cast("bigint")
    later = F.greatest(n - 2, F.lit(0))
    return upto.withColumn("n_pending", first + second + later).drop("_x", "_l", "_stop")


def allowed_or(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    value: str,
    default: str,
    allowed: str = "allowed",
) -> DataFrame:
    """Keep ``value`` where the key's list allows it, else ``default``."""
    joined = df.join(dim.select(key, allowed), key, "left")
    ok = F.coalesce(F.array_contains(F.col(allowed), F.col(value)), F.lit(False))
    return joined.withColumn(
        value, F.when(ok, F.col(value)).otherwise(F.lit(default))
    ).drop(allowed)


def next_event_after(
    df: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    t: str = "t",
    out: str = "next_t",
    layout: Layout | None = None,
) -> DataFrame:
    """Time of the first event at or after ``t``; NULL stands for "never"."""
    ev = events.select(*keys, F.col(t).alias("_t"))
    hit = nearest_rows(
        df, ev, keys, t, "_t", after="_n", table_first=False, layout=layout
    )
    return hit.withColumn(out, F.col("_n._t")).drop("_n")


def dense_pairs(vocab: DataFrame, label: str) -> DataFrame:
    """All ordered label pairs of a vocabulary, the result being their number squared."""
    base = vocab.select(F.col(label).alias("cur")).filter("cur is not null").distinct()
    return base.crossJoin(base.select(F.col("cur").alias("nxt")))


def roster_fallback(
    df: DataFrame, fallback: DataFrame, key: str, roster: str = "roster"
) -> DataFrame:
    """Roster of the fallback table where the own one is empty; such rows are not full data."""
    other = fallback.select(key, F.col(roster).alias("_fb"))
    empty = F.coalesce(F.size(roster) <= 0, F.lit(True))
    return (
        df.join(other, key, "left")
        .withColumn("full_data", ~empty)
        .withColumn(roster, F.when(empty, F.col("_fb")).otherwise(F.col(roster)))
        .drop("_fb")
    )
