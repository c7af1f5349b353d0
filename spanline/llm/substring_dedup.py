"""Substring dedup: repeated sentences and repeated word windows, the earliest kept, the rest removed by offset.

Texts are compared as words in lower case (A-Z), whatever blanks stand between them.

**Passages.** Every run of ``PASSAGE`` words or more that an earlier document holds, or the
same one without overlap further ahead, is removed word for word, wherever it stands in
sentences.  A run's windows of ``PASSAGE`` words are what is compared:

1. The anchor of a window is the least hash of its ``ANCHOR``-word grams, so equal windows
   have equal anchors.  Neighbouring windows with one anchor form a segment.
2. A segment whose words repeat an earlier one goes as a whole; those at the edges of a
   repeat are compared window by window.  Windows are cut from the texts once it is known
   which segments those are, so that few of them are ever written.

**Sentences.** Units end at a line end, or at a word that ends with ``.``, ``!`` or ``?``.
Of each digest, the smallest ``(doc_id, unit)`` is kept.  Repeats that stand side by side in
a document are removed if they have ``min_words`` words in units of ``SOLID`` words or more,
or as many in units that follow each other in one other place as well: many short units
that each occur somewhere make no passage, and a license line that many documents share
stays.

Digests and anchors are first counted over all documents, combined before the shuffle.
Those that occur twice are marked in a bitmap of 64 bits for each, 128 MB at most; only units
and segments with a mark are written to the shared folder.  False marks only cost rows.
Texts are never shuffled, and each stored table goes as soon as it has been read.

Both kinds of spans are united where they touch.

Null and empty texts have no units, documents without id are left out.  Rows that repeat
an id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm.bytewords import NOT_SPACE, Words, find_words, mix, powers, text_chunks
from spanline.llm.common import Shared

MIN_WORDS, SOLID = 30, 4
PASSAGE, ANCHOR = 51, 25
#: Bits of a mark's place in a bitmap: least, most; and within one of its slots.
LEAST_BITS, MOST_BITS, SLOT_BITS = 18, 30, 15
STOPS = np.zeros(256, bool)
STOPS[[0x2E, 0x21, 0x3F]] = True
UNIT = "doc_id bigint, text_hash bigint, unit int, word int, begin bigint, end bigint, n_words int, h1 bigint, h2 bigint"
SEGMENT = "doc_id bigint, text_hash bigint, word int, n int, begin bigint, end bigint, h bigint, r bigint"
WINDOW = "h bigint, d bigint, doc_id bigint, text_hash bigint, word int, begin bigint, end bigint"
_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _INVERSE))])
    return _inverses[:n]


class _Passages:
    """Windows of ``PASSAGE`` words inside the texts of a chunk, and their segments."""

    def __init__(self, words: Words):
        n, texts = len(words.hash), len(words.first) - 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash) * powers(max(n, 1))[:n])])
        low = self.hashes(np.arange(max(n - ANCHOR + 1, 0)), ANCHOR)
        reach, most = 1, PASSAGE - ANCHOR + 1
        while reach < most and len(low):
            step = min(reach, most - reach)
            low, reach = np.minimum(low[:-step], low[step:]), reach + step
        text = np.repeat(np.arange(texts), words.counts)
        # window k has words k .. k + PASSAGE - 1
        self.at = np.flatnonzero(text[: max(n - PASSAGE + 1, 0)] == text[PASSAGE - 1 :])
        self.low, self.text = low[self.at], text[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.low[1:] != self.low[:-1]) | (np.diff(self.text) > 0)
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.head, [len(new)]]))

    def hashes(self, start: np.ndarray, n) -> np.ndarray:
        """Hashes of the ``n`` words from each ``start`` on, equal for equal words anywhere."""
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix((self.sums[start + n] - self.sums[start]) * _inverse_powers(len(self.sums))[start])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, n``: digests of units and anchors of segments; a segment that can repeat in itself counts twice."""
    for batch in batches:
        for _, data, offsets in text_chunks(batch.column("text")):
            words = find_words(data, offsets, NOT_SPACE)
            if not len(words.hash):
                continue
            p = _Passages(words)
            h = p.low[p.head]
            every = np.concatenate([_sentences(words, data)[3][0], h, h[p.size > PASSAGE]])
            h, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n})


def _pack_bits(key: tuple, table: pa.Table) -> pa.Table:
    flags = np.zeros(1 << SLOT_BITS, bool)
    flags[table.column("bit").to_numpy() & ((1 << SLOT_BITS) - 1)] = True
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "bits": [np.packbits(flags).tobytes()]})


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Marks by the first bits of the stored values ``h``: 64 bits for each, 2^MOST_BITS (128 MB) at most."""
    n = hashes.count()
    size = min(max((64 * n).bit_length(), LEAST_BITS), MOST_BITS)
    bits = hashes.select(F.shiftrightunsigned("h", 64 - size).alias("bit")).distinct()
    slots = bits.groupBy(F.shiftright("bit", SLOT_BITS).alias("slot")).applyInArrow(
        _pack_bits, "slot bigint, bits binary"
    )
    out = np.zeros((1 << (size - SLOT_BITS), 1 << (SLOT_BITS - 3)), np.uint8)
    for r in slots.collect():
        out[r["slot"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes >> np.uint64(64 - (8 * len(marks)).bit_length() + 1)).astype(np.int64)
    return (marks[bit >> 3] >> (7 - (bit & 7))) & 1 > 0


def _place_hash(ids: np.ndarray, hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of where a segment begins."""
    return mix(mix(ids.view(np.uint64) + hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + word.astype(np.uint64))


def _columns(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def _segments(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash"))
            for lo, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, NOT_SPACE)
                p = _Passages(words)
                marked = _marked(marks.value, p.low[p.head])
                head, size = p.head[marked], p.size[marked]
                if not len(head):
                    continue
                text, at = p.text[head], p.at[head]
                char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                zero = char[offsets[text]]
                whole = p.hashes(at, size + PASSAGE - 1) + size.astype(np.uint64)
                columns = [
                    ids[lo + text],
                    hashes[lo + text],
                    (at - words.first[text]).astype(np.int32),
                    size.astype(np.int32),
                    char[words.start[at]] - zero,
                    char[words.end[at + size + PASSAGE - 2]] - zero,
                    p.low[head].view(np.int64),
                    mix(whole).view(np.int64),
                ]
                yield _columns(columns, SEGMENT)

    return run


def _windows(marks):
    """The windows of the segments whose place is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash"))
            for lo, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, NOT_SPACE)
                p = _Passages(words)
                text = p.text[p.head]
                places = _place_hash(ids[lo + text], hashes[lo + text], p.at[p.head] - words.first[text])
                marked = _marked(marks.value, places)
                head, size = p.head[marked], p.size[marked]
                if not len(head):
                    continue
                cuts = np.concatenate([[0], np.cumsum(size)])
                inside = np.repeat(head - cuts[:-1], size) + np.arange(cuts[-1])
                text, at = p.text[inside], p.at[inside]
                char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                zero = char[offsets[text]]
                columns = [
                    np.repeat(p.low[head], size).view(np.int64),
                    p.hashes(at, PASSAGE).view(np.int64),
                    ids[lo + text],
                    hashes[lo + text],
                    (at - words.first[text]).astype(np.int32),
                    char[words.start[at]] - zero,
                    char[words.end[at + PASSAGE - 1]] - zero,
                ]
                yield _columns(columns, WINDOW)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = _place_hash(*(batch.column(c).to_numpy() for c in ("doc_id", "text_hash", "word")))
        yield pa.RecordBatch.from_pydict({"h": h.view(np.int64)})


def _sentences(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First word, number of words, text and digests of the units of a chunk."""
    n = len(words.hash)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    line = np.concatenate([[0], np.cumsum(data == 10)])[words.start]
    new = np.ones(n, bool)
    new[1:] = (np.diff(text) > 0) | (np.diff(line) > 0) | STOPS[data[words.end[:-1] - 1]]
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [n]]))
    weight = powers(int(size.max()))[np.arange(n) - np.repeat(head, size)]
    digest = [
        mix(np.add.reduceat(mix(words.hash + np.uint64(salt)) * weight, head) + size.astype(np.uint64))
        for salt in (11, 12)
    ]
    return head, size, text[head], digest


def _units(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash"))
            for lo, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, NOT_SPACE)
                if not len(words.hash):
                    continue
                head, size, owner, digest = _sentences(words, data)
                unit = np.arange(len(head)) - np.searchsorted(owner, np.arange(len(offsets) - 1))[owner]
                some = _marked(marks.value, digest[0])
                head, size, owner, unit = head[some], size[some], owner[some], unit[some]
                char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                zero = char[offsets[owner]]
                columns = [
                    ids[lo + owner],
                    hashes[lo + owner],
                    unit.astype(np.int32),
                    (head - words.first[owner]).astype(np.int32),
                    char[words.start[head]] - zero,
                    char[words.end[head + size - 1]] - zero,
                    size.astype(np.int32),
                    digest[0][some].view(np.int64),
                    digest[1][some].view(np.int64),
                ]
                yield _columns(columns, UNIT)

    return run


PIECE = ["doc_id", "text_hash", "word", "word_end", "begin", "end", "_from", "n_units"]


def _repeated_sentences(rows: DataFrame, marks, shared: Shared, min_words: int) -> DataFrame:
    """``PIECE`` of the spans made of repeated units."""
    units = shared.keep(rows.mapInArrow(_units(marks), UNIT), "units")
    place = F.struct("doc_id", "unit")
    firsts = (
        units.groupBy("h1", "h2")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .filter("_first < _last")
        .select("h1", "h2", "_first")
    )
    repeats = (
        units.join(firsts, ["h1", "h2"])
        .filter(place > F.col("_first"))
        .select(
            *[c.split()[0] for c in UNIT.split(", ")[:7]],
            F.col("_first.doc_id").alias("_from"),
            F.col("_first.unit").alias("_from_unit"),
        )
        .repartition("doc_id", "text_hash")  # once for all steps below
        .dropDuplicates(["doc_id", "text_hash", "unit"])
    )
    # a window holds the repeats of one document
    along = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    span = ["doc_id", "text_hash", "_run"]
    spans = (
        repeats.withColumn("_run", F.col("unit") - F.row_number().over(along))
        .groupBy(*span, "_from", (F.col("unit") - F.col("_from_unit")).alias("_shift"))
        .agg(
            F.min("word").alias("word"),
            F.max(F.col("word") + F.col("n_words")).alias("word_end"),
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            F.sum("n_words").alias("n_words"),
            F.sum(F.when(F.col("n_words") >= SOLID, F.col("n_words")).otherwise(0)).alias("_solid"),
            F.count(F.lit(1)).alias("n_units"),
        )
        .groupBy(*span)
        .agg(
            F.min_by("_from", "begin").alias("_from"),
            F.min("word").alias("word"),
            F.max("word_end").alias("word_end"),
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            F.max("n_words").alias("_aligned"),
            F.sum("_solid").alias("_solid"),
            F.sum("n_units").alias("n_units"),
        )
    )
    out = shared.keep(spans.filter(F.greatest("_solid", "_aligned") >= min_words).select(*PIECE), "sentences")
    shared.drop("units")
    return out


def _repeated_passages(rows: DataFrame, marks, shared: Shared) -> DataFrame:
    """``PIECE`` of the windows and segments that stand further ahead as well."""
    segments = shared.keep(rows.mapInArrow(_segments(marks), SEGMENT), "segments")
    place = F.struct("doc_id", "word")
    first = F.col("_first")
    # a window that overlaps the kept one would take words from it
    again = (F.col("doc_id") > first["doc_id"]) | (
        (F.col("doc_id") == first["doc_id"]) & (F.col("word") >= first["word"] + PASSAGE)
    )
    by_words = segments.groupBy("h", "r").agg(F.min(place).alias("_first"))
    mixed = segments.groupBy("h").agg(F.min("r").alias("_r"), F.max("r").alias("_s")).filter("_r < _s").select("h", "_r")
    # the first of equal segments holds all their windows
    edge = ~again & (F.col("_r").isNotNull() | (F.col("n") > PASSAGE))
    judged = shared.keep(
        segments.join(by_words, ["h", "r"])
        .join(mixed, "h", "left")
        .filter(again | edge)
        .select("doc_id", "text_hash", "word", "n", "begin", "end", first["doc_id"].alias("_from"), again.alias("_again")),
        "judged",
    )
    shared.drop("segments")
    others = [F.col("_from"), F.lit(0).cast("bigint").alias("n_units")]
    whole = judged.filter("_again").select(
        "doc_id", "text_hash", "word", (F.col("word") + F.col("n") + (PASSAGE - 1)).alias("word_end"), "begin", "end", *others
    )
    places = shared.keep(
        judged.filter("not _again").select("doc_id", "text_hash", "word").mapInArrow(_places, "h bigint"), "places"
    )
    marked = rows.sparkSession.sparkContext.broadcast(_bitmap(places))
    windows = shared.keep(rows.mapInArrow(_windows(marked), WINDOW), "windows")
    firsts = (
        windows.groupBy("h", "d")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .filter("_first < _last")
        .drop("_last")
    )
    single = windows.join(firsts, ["h", "d"]).filter(again).select(
        "doc_id", "text_hash", "word", (F.col("word") + PASSAGE).alias("word_end"), "begin", "end",
        first["doc_id"].alias("_from"), F.lit(0).cast("bigint").alias("n_units"),
    )
    out = shared.keep(whole.unionByName(single), "passages")
    shared.drop("judged", "places", "windows")
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_hash, begin, end, n_words, n_units, first_doc_id`` of each span to remove.

    ``n_units`` counts the whole sentences that were found as such, ``first_doc_id`` holds
    an earlier occurrence of the span's first words.
    """
    rows = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    shared = Shared(docs.sparkSession, "substring-dedup")
    hashes = rows.select("text").mapInArrow(_hashes, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = shared.keep(hashes.filter("n > 1").select("h"), "repeated")
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(repeated))
    shared.drop("repeated")
    pieces = _repeated_sentences(rows, marks, shared, min_words).unionByName(_repeated_passages(rows, marks, shared))
    marks.unpersist()
    # a window holds the repeats of one document
    along = Window.partitionBy("doc_id", "text_hash").orderBy("word", "word_end")
    ahead = F.max("word_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return (
        pieces.repartition("doc_id", "text_hash")
        .dropDuplicates(["doc_id", "text_hash", "word", "word_end", "n_units"])
        .withColumn("_new", F.when(F.col("word") <= ahead, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_hash", "_run")
        .agg(
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            (F.max("word_end") - F.min("word")).cast("bigint").alias("n_words"),
            F.sum("n_units").alias("n_units"),
            F.min(F.struct("word", "_from"))["_from"].alias("first_doc_id"),
        )
        .drop("_run")
    )


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text``."""
    cuts = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_cuts")
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    kept = F.expr(
        """array_join(transform(sequence(0, size(_cuts)), i -> substring(doc.text,
             cast(if(i = 0, 0, _cuts[i - 1].end) + 1 as int),
             cast(if(i = size(_cuts), char_length(doc.text), _cuts[i].begin)
               - if(i = 0, 0, _cuts[i - 1].end) as int))), '')"""
    )
    same = (F.col("doc.doc_id") == F.col("_id")) & (F.xxhash64("doc.text") == F.col("_hash"))
    text = F.when(F.col("_cuts").isNull(), F.col("doc.text")).otherwise(kept)
    return rows.join(cuts, same, "left").select(
        *[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns]
    )
