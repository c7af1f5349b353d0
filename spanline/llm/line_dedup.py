"""Line dedup by sorted hashes: each line stays in the smallest document that holds it.

A line's key is the line without blanks and control whitespace at its ends, lower-cased
(A-Z).  Only two 64-bit hashes of a key travel, with the document and the line's position.

1. Lines are hashed once into a table in the shared folder.
2. Keys that make up more than 1 / ``HOT`` of all lines are found exactly: counts per
   ``BUCKETS`` buckets of the hash, then per key within the heavy buckets.  There are
   fewer than ``HOT`` of them, whatever the input, so they are broadcast, each with its
   smallest document; their lines are judged where they lie.
3. The rest is range-partitioned by hash and sorted by hash, document and position; one
   streaming pass per partition compares each line with the first of its hash.
4. Dropped lines become bitmaps: 64 lines a word, and only words with a dropped line are
   kept.  A document without a bitmap keeps all its lines.

Null or empty text is one empty line.  A document without id neither loses lines nor makes
others lose theirs.  Rows that repeat an id count as one document; repeated rows lose the
same lines.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm.common import Shared, ascii_lower

MIN_CHARS = 10
BUCKETS, HOT = 1 << 16, 1024
BLANKS = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2`` of every line whose key is long enough."""
    lines = docs.filter("doc_id is not null").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    key = ascii_lower(F.trim(F.col("line"), F.lit(BLANKS)))
    return (
        lines.filter(F.char_length("line") >= min_chars)
        .withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def dropped_lines(lines: DataFrame) -> DataFrame:
    """The rows of ``hashed_lines`` that another, smaller document holds as well."""
    least = lines.count() / HOT
    bucket = F.pmod("h1", F.lit(BUCKETS))
    heavy = lines.groupBy(bucket.alias("_bucket")).count().filter(F.col("count") > least).select("_bucket")
    hot = (
        lines.withColumn("_bucket", bucket)
        .join(F.broadcast(heavy), "_bucket", "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"))
        .filter(F.col("_n") > least)
        .select("h1", "h2", "_first")
    )
    from_hot = lines.join(F.broadcast(hot), ["h1", "h2"])
    sorted_rest = (
        lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
        .repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
    )
    ahead = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    from_rest = sorted_rest.withColumn("_first", F.first("doc_id").over(ahead))
    return from_hot.unionByName(from_rest).filter("doc_id > _first").drop("_first")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, n_dropped, keep`` for each document that loses lines.

    ``keep`` is an array of ``(word, bits)``: bit ``i`` of word ``w`` says whether line
    ``64 * w + i`` stays; words that aren't listed stay whole.
    """
    lines = Shared(docs.sparkSession, "line-dedup").keep(hashed_lines(docs, min_chars), "lines")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))"))
    words = (
        dropped_lines(lines)
        .groupBy("doc_id", "text_hash", F.expr("cast(pos div 64 as int)").alias("word"))
        .agg(bits.alias("_gone"))
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("_gone")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("_gone").alias("bits")))).alias("keep"),
    )


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """A struct ``doc`` of ``docs``' columns, ``n_lines``, ``n_dropped``, ``kept_text``."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    maps = bitmaps.select(
        F.col("doc_id").alias("_id"),
        F.col("text_hash").alias("_hash"),
        "n_dropped",
        F.map_from_entries("keep").alias("_keep"),
    )
    same = (F.col("doc.doc_id") == F.col("_id")) & (F.xxhash64("doc.text") == F.col("_hash"))
    stays = F.expr(
        "filter(_lines, (x, i) -> coalesce(getbit(_keep[cast(i div 64 as int)], cast(i % 64 as int)) = 1, true))"
    )
    text = F.coalesce("doc.text", F.lit(""))
    return (
        rows.join(maps, same, "left")
        .withColumn("_lines", split_lines(F.col("doc.text")))
        .select(
            "doc",
            F.size("_lines").cast("bigint").alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
            F.when(F.col("_keep").isNull(), text).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
        )
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as ``text``."""
    out = with_kept_text(docs, keep_bitmaps(docs, min_chars))
    return out.select(
        *[F.col("kept_text").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns]
    )
