"""Temperature mixing: source shares to a power, met by budgeted block permutations.

A source with share ``p`` of all tokens gets the weight ``p^a / sum p^a``.  The exponent
``a`` is the largest up to 1 whose weights reach a target entropy, or the least at which no
source repeats more than a limit allows, whichever is larger: the limit wins.  It is
bisected, six halvings a pass over the table of sources; only sums go to the driver.

A budget of tokens is realised in blocks of a fixed number of tokens, each holding every
source by its weight.  A source is read in passes (epochs); a pass is the permutation of
its documents by a keyed hash.  A document's place is the number of tokens ahead of it in
its source, which decides its block; so a source is cut where its part of the budget ends,
or begins again where its documents do not fill it.

Documents have one token more than words (their end), so that none is empty.  Null is a
source like any other.  Rows that repeat id, source and text count as one document, in the
budget and in the result.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm.common import Shared, running_total

TARGET, LIMIT = 0.97, 4.0
BLOCK = 1 << 16
PASSES, PARTS = 5, 64


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text_hash, n_tokens``, one row per document."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return (
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), (words + 1).alias("n_tokens"))
        .groupBy("doc_id", "source", "text_hash")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )


def _figures(sources: DataFrame, total: int, budget: float | None, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: entropy as a part of the most there can be, and the largest repetition."""
    raised = sources.select(
        F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"),
        F.col("tokens").cast("double").alias("t"),
    ).withColumn("r", F.pow(F.col("t") / total, F.col("a")))
    rows = raised.groupBy("a").agg(
        F.sum("r").alias("z"),
        F.sum(F.col("r") * F.log("r")).alias("e"),
        F.max(F.col("r") / F.col("t")).alias("most"),
        F.min(F.col("r") / F.col("t")).alias("least"),
        F.count(F.lit(1)).alias("k"),
        F.log(F.sum("r")).alias("log_z"),
        F.log(F.count(F.lit(1))).alias("log_k"),
    )
    got = {x["a"]: x for x in rows.collect()}
    out = []
    for x in (got[a] for a in exponents):
        entropy = (x["log_z"] - x["e"] / x["z"]) / x["log_k"] if x["k"] > 1 else 1.0
        # without a budget: as many tokens as bring every document once
        times = x["most"] / x["least"] if budget is None else budget * x["most"] / x["z"]
        out.append((entropy, times))
    return out


def _exponent(sources, total, budget, target: float, limit: float) -> float:
    """The largest exponent that meets ``target``, raised to the least that meets ``limit``."""
    found = []
    for passes, falls in ((lambda x: x[0] >= target, True), (lambda x: x[1] <= limit, False)):
        low, size = 0, PARTS**PASSES
        for _ in range(PASSES):
            size //= PARTS
            grid = [low + i * size for i in range(PARTS + 1)]
            good = [passes(x) for x in _figures(sources, total, budget, [g / PARTS**PASSES for g in grid])]
            if falls:
                at = max((i for i, g in enumerate(good) if g), default=0)
                low = grid[at]
                if at == PARTS:
                    break
            else:
                at = min((i for i, g in enumerate(good) if g), default=PARTS)
                if at == 0:
                    break
                low = grid[at - 1] if size > 1 else grid[at]
        found.append(low / PARTS**PASSES)
    return max(found)


def weights(
    sources: DataFrame, target: float = TARGET, limit: float = LIMIT, cover: bool = False
) -> tuple[DataFrame, float]:
    """``source, tokens, weight`` of a stored table ``source, tokens``, and the budget in tokens.

    The budget is all tokens there are or, with ``cover``, the fewest that bring every
    document at least once.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    exponent = _exponent(sources, total, None if cover else float(total), target, limit) if total else 1.0
    raised = sources.withColumn("_r", F.pow(F.col("tokens").cast("double") / F.lit(max(total, 1)), F.lit(exponent)))
    sums = raised.agg(F.sum("_r").alias("z"), F.max(F.col("tokens") / F.col("_r")).alias("most")).first()
    z = sums["z"] or 1.0
    budget = (sums["most"] or 0.0) * z if cover else float(total)
    return raised.select("source", "tokens", (F.col("_r") / F.lit(z)).alias("weight")), budget


def mixture(
    docs: DataFrame,
    target: float = TARGET,
    limit: float = LIMIT,
    cover: bool = False,
    block: int = BLOCK,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, source, text_hash, n_tokens, epoch, block, slot`` for every document drawn."""
    shared = Shared(docs.sparkSession, "mixing")
    rows = shared.keep(counted(docs), "rows")
    sources = shared.keep(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    weighed, budget = weights(sources, target, limit, cover)
    plan = shared.keep(
        weighed.select(
            F.col("source").alias("_source"),
            "tokens",
            F.round(F.col("weight") * budget).cast("bigint").alias("_part"),
            (F.col("weight") * block).alias("_quota"),
        ),
        "plan",
    )
    passes = F.expr("sequence(0, greatest(cast(ceil(_part / tokens) as int) - 1, 0))")
    key = F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    drawn = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("epoch", F.explode(passes))
        .withColumn("_key", key)
    )
    placed = running_total(
        drawn, ["source", "epoch"], F.substring("_key", 1, 3), ["_key", "text_hash"], F.col("n_tokens"), "_ahead"
    ).withColumn("_at", F.col("_ahead") + F.col("epoch") * F.col("tokens"))
    blocks = placed.filter(F.col("_at") < F.col("_part")).withColumn(
        "block", F.floor(F.col("_at") / F.col("_quota"))
    )
    # a block holds a fixed number of tokens, and each row has one at least
    inside = Window.partitionBy("block").orderBy("_key", "source", "text_hash")
    return blocks.withColumn("slot", F.row_number().over(inside) - 1).select(
        "doc_id", "source", "text_hash", "n_tokens", "epoch", "block", "slot"
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture draws, once for each time it draws them."""
    drawn = mixture(docs, **options).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash")
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    same = (
        F.col("doc.doc_id").eqNullSafe(F.col("_id"))
        & F.col("doc.source").eqNullSafe(F.col("_source"))
        & (F.xxhash64("doc.text") == F.col("_hash"))
    )
    return rows.join(drawn, same).select("doc.*")
