"""Benchmark decontamination: every benchmark suffix searched in suffix arrays of the corpus.

Texts are lower-cased (A-Z); words are runs of letters, digits and characters outside
ASCII.  Each task builds suffix arrays over stretches of its documents (shards) and
binary-searches every suffix of the benchmark in each.  Where the longest match reaches a
window (13 words, or the whole of a shorter item), all places of the window are read off
the array; windows of an item that follow each other form one verbatim match.

The corpus is neither shuffled nor collected, so copies in any number cost what they
weigh.  The benchmark travels to the tasks in blocks of at most about ``BLOCK_BYTES`` of
text, or one larger item; further blocks are further passes.  Words are compared by 64-bit hashes.

A document without text has no words and no hits.  Items without id or words take no part;
an item id that repeats stands for all its texts, once for each distinct one, and may be of any
type.  Rows that repeat are each judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.llm.bytewords import ALNUM, find_words, text_chunks
from spanline.llm.common import Shared, running_total
from spanline.llm.suffixes import Shard

WINDOW = 13
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
MATCH = ["word", "n_words", "item_id"]


class Suite:
    """The words of one block of benchmark items."""

    def __init__(self, items: pa.Table, window: int):
        column = pa.chunked_array(items.column("text")).combine_chunks()
        hashes, item, left = [], [], []
        for lo, data, offsets in text_chunks(column):
            words = find_words(data, offsets, ALNUM)
            n = words.counts
            hashes.append(words.hash)
            item.append(np.repeat(np.arange(lo, lo + len(n)), n))
            left.append(np.repeat(words.first[1:], n) - np.arange(len(words.hash)))
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash, self.item, self.left = whole(hashes, np.uint64), whole(item, np.int64), whole(left, np.int64)
        self.id = pa.chunked_array(items.column("item_id")).combine_chunks()
        total = np.bincount(self.item, minlength=len(self.id))
        self.window = np.minimum(window, total)[self.item] if len(self.item) else self.left
        self.depth = int(total.max()) + 1 if len(total) else 1

    def occurrences(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(benchmark word, place in the shard) of every window found."""
        words = shard.number(self.hash)
        t = np.flatnonzero(self.left >= self.window)
        t = t[shard.longest(words, t, self.left[t]) >= self.window[t]]
        low = shard.bound(words, t, self.window[t], after=False)
        n = shard.bound(words, t, self.window[t], after=True) - low
        slot = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(t, n), shard.order[slot]


def _matches(suite: Suite, hashes, first) -> tuple[np.ndarray, ...]:
    """Maximal matches made of windows: text, first word in it, number of words, number of the item."""
    shard = Shard(hashes, first, suite.depth)
    t, place = suite.occurrences(shard)
    item = suite.item[t]
    order = np.lexsort((place, place - t, item))
    t, place, item = t[order], place[order], item[order]
    new = np.ones(len(t), bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(place) != 1) | (np.diff(t) != 1)
    head = np.flatnonzero(new)
    run = np.diff(np.concatenate([head, [len(t)]]))
    text = shard.text[place[head]]
    order = np.argsort(text, kind="stable")
    head, run, text = head[order], run[order], text[order]
    return text, place[head] - shard.begin[text], run - 1 + suite.window[t[head]], item[head]


def _search(suite, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column("text"), SHARD_BYTES):
                words = find_words(data, offsets, ALNUM)
                n = len(offsets) - 1
                text, word, length, item = _matches(suite.value, words.hash, words.first)
                found = pa.StructArray.from_arrays(
                    [pa.array(word), pa.array(length), suite.value.id.take(pa.array(item))], MATCH
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, n) for c in carry]
                    + [
                        pa.array(words.counts.astype(np.int64)),
                        pa.ListArray.from_arrays(
                            np.searchsorted(text, np.arange(n + 1)).astype(np.int32), found
                        ),
                    ],
                    names=[*carry, "n_words", "matches"],
                )

    return run


def dealt(items: DataFrame, block_bytes: int) -> DataFrame:
    """Distinct ``item_id, text`` with ``block``: items that begin within the same ``block_bytes`` of text."""
    rows = items.distinct().withColumn("_bytes", F.octet_length("text").cast("bigint"))
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(64))
    placed = running_total(rows, [], bucket, ["item_id", "text"], F.col("_bytes"), "_ahead")
    return placed.select("item_id", "text", F.floor(F.col("_ahead") / block_bytes).alias("block"))


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A struct ``doc`` of the ``keep`` columns (all by default), ``n_words``, and ``matches``.

    A match is a place in words, a length in words, and the item's id.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    kind = items.schema["item_id"].dataType.simpleString()
    matches = f"n_words bigint, matches array<struct<word: bigint, n_words: bigint, item_id: {kind}>>"
    shared = Shared(spark, "decontaminate")
    items = shared.keep(dealt(items, block_bytes), "items")
    numbers = [r["block"] for r in items.select("block").distinct().orderBy("block").collect()] or [0]
    blocks = len(numbers)
    keep = docs.columns if keep is None else keep
    others = F.struct(F.lit(0).alias("_"), *[docs[c] for c in keep if c != "text"])
    rows = docs.select(others.alias("doc"), "text")
    for k, number in enumerate(numbers):
        part = items.filter(F.col("block") == number).select("item_id", "text")
        suite = spark.sparkContext.broadcast(Suite(part.toArrow(), window))
        carry = ["doc"] + ["text"] * ("text" in keep or k + 1 < blocks) + ["before"] * bool(k)
        types = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry]
        found = rows.select("doc", "text", *["before"] * bool(k)).mapInArrow(
            _search(suite, carry), ", ".join([*types, matches])
        )
        if k:
            found = found.withColumn("matches", F.concat("before", "matches")).drop("before")
        if k + 1 < blocks:
            found = shared.keep(found, f"block-{k}")
            rows = found.select("doc", "text", F.col("matches").alias("before"))
    fields = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in keep]
    return found.select(F.struct(*fields).alias("doc"), "n_words", "matches")


def hit_words(matches: Column) -> Column:
    """How many words lie inside at least one match."""
    ends = lambda m: m["word"] + m["n_words"]
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda s, m: F.struct(
        (s["n"] + F.greatest(ends(m) - F.greatest(m["word"], s["end"]), F.lit(0))).alias("n"),
        F.greatest(ends(m), s["end"]).alias("end"),
    )
    return F.aggregate(F.array_sort(matches), start, step)["n"]


def judged(found: DataFrame) -> DataFrame:
    """Adds ``n_hit``, ``items`` (distinct ids), ``contaminated``: hits in at least a twentieth of the words."""
    return (
        found.withColumn("n_hit", hit_words(F.col("matches")))
        .withColumn("items", F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return judged(find_matches(docs, benchmark, window=window)).filter("not contaminated").select("doc.*")
