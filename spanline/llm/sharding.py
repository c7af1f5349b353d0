"""Sharding by balanced label propagation: linked documents gather, counts stay even.

Documents that hang on the same *hub* are linked (here: equal texts; any table of links
can be given as hubs of two).  A hub larger than a shard first fills as many shards as it
can on its own; what is left of it is spread like the rest, over the other shards.  Linked
documents start round robin.  In each round

1. the number of each hub's members per shard is counted, combined before the shuffle;
2. each document looks at the shards of its hubs that rank above its own by members
   (ties by a hash of hub and shard), and proposes to move to one of those with room, drawn
   by how much room, or to the top one where none has;
3. quotas bound the moves: between two shards as many go each way as come back, and what
   is left over shares the target's free places.  Proposals are taken in the order of
   their hubs, so that members move together.

Then unlinked documents fill what is free.  Shard ``i`` of ``n`` holds exactly
``floor(N / n)`` documents, one more for ``i < N mod n`` (law ``rows``).

Ranks and slots come from counts per hash bucket plus a window within the bucket, so that
no task holds a shard, a pair of shards or a hub as a whole.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm.common import Shared, running_total
from spanline.session import small_table

BUCKETS = 1024
ROUNDS = 8
SLACK = 16


def _bucket(c: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), c), F.lit(BUCKETS))


def _by_hub(hub: str, salt: int) -> Column:
    """Buckets that keep small hubs together; a large hub still takes 16."""
    return _bucket(F.col(hub), salt) * 16 + F.pmod(F.xxhash64("row"), F.lit(16))


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _proposals(members: DataFrame, labels: DataFrame, room: DataFrame, step: int) -> DataFrame:
    """``(row, source, target, order)`` of documents that would rather be elsewhere."""
    placed = members.join(labels, "row")
    cells = placed.groupBy("hub", "shard").agg(F.count(_one()).alias("n"))
    # one row per shard at most in a hub's window
    rank = Window.partitionBy("hub").orderBy(F.col("n").desc(), F.xxhash64("hub", "shard"), "shard")
    free = cells.join(F.broadcast(room), "shard")
    ahead = rank.rowsBetween(Window.unboundedPreceding, -1)
    top = F.first(F.struct("shard", "n"))
    options = F.collect_list(F.when(F.col("free") > 0, F.struct("free", "shard", "n")))
    better = free.select(
        F.col("hub").alias("_hub"),
        F.col("shard").alias("source"),
        options.over(ahead).alias("_options"),
        top.over(ahead).alias("_top"),
    ).filter("_top is not null")
    # (hub, shard) cells, so a hub's members split over its shards; then one proposal per document
    drawn = F.expr(
        """aggregate(_options, named_struct('left', _draw, 'found', cast(null as struct<shard: int, n: bigint>)),
             (a, x) -> named_struct('left', a.left - x.free, 'found',
               if(a.found is null and a.left < x.free, named_struct('shard', x.shard, 'n', x.n), a.found))).found"""
    )
    wish = (
        placed.join(better, (F.col("hub") == F.col("_hub")) & (F.col("shard") == F.col("source")))
        .withColumn("_room", F.expr("aggregate(_options, 0L, (s, x) -> s + x.free)"))
        .withColumn("_draw", F.when(F.col("_room") > 0, F.pmod(F.xxhash64("row", F.lit(step)), "_room")))
        .withColumn("_better", F.coalesce(drawn, "_top"))
        .select("row", "hub", "source", F.col("_better.shard").alias("target"), F.col("_better.n").alias("gain"))
    )
    best = F.max_by(F.struct("target", "hub"), F.struct("gain", F.xxhash64("hub", "target")))
    return (
        wish.groupBy("row", "source")
        .agg(best.alias("_b"))
        .select("row", "source", F.col("_b.target").alias("target"), F.col("_b.hub").alias("order"))
    )


def _accepted(proposals: DataFrame, room: DataFrame) -> DataFrame:
    """Those within their quota, as ``(row, target)``."""
    flow = proposals.groupBy("source", "target").agg(F.count(_one()).alias("n"))
    back = flow.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("n").alias("m"))
    # at most shards * shards rows
    both = flow.join(back, (F.col("source") == F.col("_t")) & (F.col("target") == F.col("_s")), "left").select(
        "source", "target", "n", F.least("n", F.coalesce("m", F.lit(0))).alias("swap")
    )
    total = F.sum(F.col("n") - F.col("swap")).over(Window.partitionBy("target"))
    over = F.col("n") - F.col("swap")
    quota = both.join(room.withColumnRenamed("shard", "target"), "target").withColumn("_total", total).select(
        F.col("source").alias("_s"),
        F.col("target").alias("_t"),
        (
            F.col("swap")
            + F.when(F.col("_total") > 0, F.least(over, F.expr("free * (n - swap) div _total"))).otherwise(0)
        ).alias("quota"),
    )
    ranked = running_total(
        proposals, ["source", "target"], _by_hub("order", 1), ["order", "row"], _one(), "rank"
    )
    return ranked.join(
        F.broadcast(quota), (F.col("source") == F.col("_s")) & (F.col("target") == F.col("_t"))
    ).filter("rank < quota").select("row", "target")


def _whole_shards(members: DataFrame, sizes: list[int], shared: Shared) -> tuple[DataFrame | None, list[int]]:
    """``(row, shard)`` of the shards that one hub fills alone, and the numbers of those shards."""
    least = max(min(sizes), 2)
    # at least ``least`` rows each, so no more hubs than about the shards
    large = members.groupBy("hub").agg(F.count(_one()).alias("n")).filter(F.col("n") >= least).select("hub")
    if not large.limit(1).count():
        return None, []
    # a row that hangs on several goes with one of them
    rows = shared.keep(members.join(F.broadcast(large), "hub").groupBy("row").agg(F.min("hub").alias("hub")), "large")
    taken, parts = 0, []
    for r in sorted(rows.groupBy("hub").count().collect(), key=lambda r: (-r["count"], r["hub"])):
        first = 0
        while taken < len(sizes) and first + sizes[taken] <= r["count"]:
            parts.append((r["hub"], first, first + sizes[taken], taken))
            first, taken = first + sizes[taken], taken + 1
    if not parts:
        return None, []
    kind = members.schema["hub"].dataType.simpleString()
    plan = small_table(rows.sparkSession, parts, f"_hub {kind}, low bigint, high bigint, shard int")
    here = (F.col("hub") == F.col("_hub")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    placed = running_total(rows, ["hub"], _bucket(F.col("row"), 7), ["row"], _one(), "place")
    # one row a shard at most
    return shared.keep(placed.join(F.broadcast(plan), here).select("row", "shard"), "whole"), list(range(taken))


def shard_rows(rows: DataFrame, members: DataFrame, shards: int, shared: Shared, rounds: int = ROUNDS) -> DataFrame:
    """``(row, shard, slot)`` for each ``row`` of ``rows``; ``members (row, hub)`` says who is linked.

    Both have to be stored tables, with ``row`` unique in ``rows``.
    """
    spark = rows.sparkSession
    n = rows.count()
    least, more = divmod(n, shards)
    whole, full = _whole_shards(members, [least + (k < more) for k in range(shards)], shared)
    if whole is not None:
        rows = shared.keep(rows.select("row").join(whole, "row", "left_anti"), "rest")
        members = shared.keep(members.join(whole, "row", "left_anti"), "rest-members")
    left = [k for k in range(shards) if k not in full]
    numbers = F.array(*[F.lit(k) for k in left or [0]])
    size = F.when(F.col("id") < more, least + 1).otherwise(least)
    capacity = (
        spark.range(shards)
        .filter(F.col("id") >= len(full))
        .select(F.col("id").cast("int").alias("shard"), size.alias("capacity"))
    )

    def room(labels: DataFrame, slack: int = 0) -> DataFrame:
        load = labels.groupBy("shard").agg(F.count(_one()).alias("_load"))
        return capacity.join(load, "shard", "left").select(
            "shard", (F.col("capacity") + slack - F.coalesce("_load", F.lit(0))).alias("free")
        )

    linked = members.select("row").distinct()
    start = running_total(linked, [], _bucket(F.col("row"), 2), ["row"], _one(), "place")
    labels = shared.keep(
        start.select("row", F.get(numbers, F.pmod("place", F.lit(max(len(left), 1))).cast("int")).alias("shard")),
        "labels-0",
    )
    step = 0
    for step in range(1, rounds + 1):
        here = room(labels, least // SLACK)
        wanted = shared.keep(_proposals(members, labels, here, step), f"proposals-{step}")
        moves = shared.keep(_accepted(wanted, here), f"moves-{step}")
        moved = labels.join(moves, "row", "left").select("row", F.coalesce("target", "shard").alias("shard"))
        labels = shared.keep(moved, f"labels-{step}")
        some = moves.limit(1).count()
        shared.drop(f"labels-{step - 1}", f"proposals-{step}", f"moves-{step}")
        if not some:
            break

    # what is over a shard's size goes to the free places first, hub by hub
    hubs = members.groupBy("row").agg(F.min("hub").alias("hub"))
    ranked = shared.keep(
        running_total(labels.join(hubs, "row"), ["shard"], _by_hub("hub", 5), ["hub", "row"], _one(), "rank").join(
            F.broadcast(capacity), "shard"
        ),
        "ranked",
    )
    inside, over = ranked.filter("rank < capacity").select("row", "shard"), ranked.filter("rank >= capacity")
    n_over = over.count()
    first = running_total(over.select("row", "hub"), [], _by_hub("hub", 6), ["hub", "row"], _one(), "place")
    rest = running_total(
        rows.select("row").join(linked, "row", "left_anti"), [], _bucket(F.col("row"), 3), ["row"], _one(), "place"
    )
    fillers = first.select("row", "place").union(rest.select("row", F.col("place") + n_over))
    # one number per shard: the free places up to it
    free = {r["shard"]: r["free"] for r in room(inside).collect()}
    upto = list(accumulate(free[k] for k in left)) or [0]
    shard = F.get(numbers, F.size(F.filter(F.array(*[F.lit(x) for x in upto]), lambda x: x <= F.col("place"))))
    found = inside.unionByName(fillers.select("row", shard.alias("shard")))
    placed = shared.keep(found if whole is None else found.unionByName(whole), "placed")
    return running_total(placed, ["shard"], _bucket(F.col("row"), 4), ["row"], _one(), "slot")


def assign_shards(docs: DataFrame, keep: list[str], shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """The ``keep`` columns of every row in a struct ``doc``, with its place among the shards.

    ``size`` is the text's bytes and 16; ``text_crc32`` of a null text is 0.  Equal texts
    are linked; null texts are linked with nothing.  Repeated rows each have a place.
    """
    shared = Shared(docs.sparkSession, "sharding")
    rows = shared.keep(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.struct(*[docs[c] for c in keep]).alias("doc"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 16).alias("size"),
            F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.md5(F.encode("text", "utf-8")).alias("hub"),
        ),
        "rows",
    )
    hubs = rows.filter("hub is not null").groupBy("hub").agg(F.count(_one()).alias("_n")).filter("_n > 1")
    members = shared.keep(rows.select("row", "hub").join(hubs.select("hub"), "hub", "left_semi"), "members")
    placed = shard_rows(rows, members, shards, shared, rounds)
    return rows.join(placed, "row").select(
        "doc",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
