"""Importance resampling: documents drawn by how much likelier the target makes their words.

Features are runs of one to three words, counted into ``BUCKETS`` buckets by CRC-32.  The
two count arrays, of the corpus and of the target, give a gain for each bucket (one pass
over each; only arrays of ``BUCKETS`` numbers go to the driver and back).  A document's
weight is the sum of its features' gains, its score adds noise drawn from its id, so that
the highest scores are a sample without replacement in proportion to the weights.

Ranks: a histogram of scores finds a bound that no drawn document lies below; the rest is
sorted by score, then by id, with a distributed radix sort (``radix.ranks``).

Null and empty texts have no features and weigh 0; they can't be drawn, as they have fewer
than ``min_words`` words.  Null ids are drawn like others and come last among equal scores.
Repeated rows count each, as rows of the corpus and as candidates; among rows equal in
score and id it makes no difference which has which rank.  Empty tables: without documents
the result is empty, without a target all counts of it are 0.  Whole texts are read, in
stretches, so a long text needs little more memory than its words' places.  Other columns
come back in the struct ``doc``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.llm import crc, radix
from spanline.llm.bytewords import ALNUM, text_chunks, word_spans
from spanline.llm.common import Shared

BUCKETS = 10_000


def _runs(data: np.ndarray, offsets: np.ndarray):
    start, end = word_spans(data, offsets, ALNUM)
    first = np.searchsorted(start, offsets)
    return first, crc.runs(data, start, end, first)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("text")):
                for _, _, sums in _runs(data, offsets)[1]:
                    for s in sums:
                        n += np.bincount(s % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": n[some]})

    found = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target makes each bucket, rounded down."""
    of_corpus, of_target = (float(x.sum() + len(x)) for x in (corpus, target))
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * of_corpus / ((float(s) + 1) * of_target)))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, keep: list[str], gain: np.ndarray) -> DataFrame:
    """``doc`` (struct of the ``keep`` columns), ``n_words``, ``n_features``, ``weight``."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column("text")):
                first, blocks = _runs(data, offsets)
                ahead = np.zeros(first[-1] + 1, np.int64)
                for lo, words, sums in blocks:
                    for w, s in zip(words, sums, strict=True):
                        ahead[1 + lo + w] += gain[s % np.uint32(len(gain))]
                weight = np.diff(np.cumsum(ahead)[first])
                n = np.diff(first)
                features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(row, len(n)), *map(pa.array, (n, features, weight))],
                    names=["doc", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), "text")
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate drawn from the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _bound(scores: DataFrame, draw: int) -> int | None:
    """A score that at least ``draw`` rows reach, by a histogram of a radix digit's size."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    shift = max(0, (high - low).bit_length() - radix.WIDTH)
    below = F.shiftright(F.lit(high) - F.col("score"), shift)
    seen = 0
    for r in sorted(scores.groupBy(below.alias("b")).count().collect()):
        seen += r["count"]
        if seen >= draw:
            return high - ((r["b"] + 1) << shift) + 1
    return None


def resample(
    docs: DataFrame,
    target: DataFrame,
    keep: list[str],
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    stretch: int = radix.STRETCH,
) -> DataFrame:
    """``doc``, ``n_features``, ``weight``, ``score`` of every row, and ``rank`` (from 1) of those drawn.

    ``percent`` of the rows with at least ``min_words`` words are drawn.  ``docs`` has ``doc_id``
    and ``text``, ``target`` has ``text``.
    """
    shared = Shared(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    named = docs.select(F.struct(docs["doc_id"], F.struct(*[docs[c] for c in keep]).alias("kept")).alias("doc"), "text")
    scored = shared.keep(
        weigh(named, ["doc"], gain).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc.doc.doc_id").alias("id"),
            F.col("doc.doc.kept").alias("doc"),
            "n_words",
            "n_features",
            "weight",
            (F.col("weight") + noise(F.col("doc.doc.doc_id"), seed)).alias("score"),
        ),
        "scored",
    )
    able = scored.filter(F.col("n_words") >= min_words).select("row", "id", "score")
    draw = able.count() * percent // 100
    if not draw:
        return scored.select("doc", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    least = _bound(able, draw)
    high = able.agg(F.max("score")).first()[0]
    keys = able.filter(F.col("score") >= least).select(
        "row",
        ((F.lit(high) - F.col("score")) * 2 + F.col("id").isNull().cast("bigint")).alias("hi"),
        # the sign bit flipped: as numbers without sign, ids keep their order
        F.coalesce(F.col("id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0)).alias("lo"),
    )
    places = radix.ranks(shared.keep(keys, "keys"), shared, stretch)
    drawn = places.filter(F.col("pos") < draw).select(F.col("row").alias("_row"), (F.col("pos") + 1).alias("rank"))
    return scored.join(drawn, F.col("row") == F.col("_row"), "left").select("doc", "n_features", "weight", "score", "rank")
