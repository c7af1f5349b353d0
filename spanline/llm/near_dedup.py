"""Near duplicates by SetSketch registers: bands of registers, estimates, exact checks.

Texts are lower-cased (A-Z) and cut at blanks and control whitespace; a document's set is
its five-word shingles, or its whole sequence of words where it has fewer.

1. Documents with the same sequence of words form a *text group*; its smallest id stands
   for it.  A group of any size is one row from there on.
2. Each text has ``BANDS * ROWS`` registers.  Two texts are candidates if all registers
   of a band are equal.  At a similarity of 0.75 a pair is missed with a probability of
   ``(1 - 0.75^4)^40``, 2.5e-7; at more, with less.
3. Candidates of a band are first held against one of its members only (a star, one pair
   a member), the one that shares bands with most texts.  Links that pass are joined into
   components.  Pairs of a band that are in different components are held against each
   other, but for those that a bound from unshared elements and from the distance to the
   band's centre rules out.  A pair left out is already connected or surely no link, so
   components come out as if all pairs had been checked.
4. Pairs are sifted by set size, then by the likelihood estimate from their registers
   (kept from 0.55 on, five standard errors below 0.75), then confirmed on whole sets.

Null and repeated rows: a null or empty text has no set and is linked with nothing; rows
with a null id form no group but find theirs; repeated ids count as one document.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import sketch
from spanline.llm.bytewords import NOT_SPACE, chain, find_words, mix, sequence_hash, text_chunks
from spanline.llm.common import Shared
from spanline.llm.components import components

WORDS = 5
BANDS, ROWS = 40, 4
SURELY_BELOW = 0.55
SIGNATURE = "doc_id bigint, h1 bigint, h2 bigint, n_shingles bigint, bands array<bigint>, regs binary"


def shingle_sets(data, offsets) -> tuple[np.ndarray, np.ndarray, object]:
    """Distinct shingle hashes of each text, sorted; where each text's begin; its words."""
    words = find_words(data, offsets, NOT_SPACE)
    n = words.counts
    per = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(first[-1], np.uint64)
    every = chain(words.hash, WORDS)
    long, short = np.flatnonzero(n >= WORDS), np.flatnonzero((n > 0) & (n < WORDS))
    if len(long):
        places = np.arange(per[long].sum()) - np.repeat(np.cumsum(per[long]) - per[long], per[long])
        out[np.repeat(first[long], per[long]) + places] = every[
            np.repeat(words.first[long], per[long]) + places
        ]
    out[first[short]] = sequence_hash(words, 1)[short]
    order = np.lexsort((out, np.repeat(np.arange(len(n)), per)))
    out, owner = out[order], np.repeat(np.arange(len(n)), per)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(len(n) + 1)), words


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, data, offsets in text_chunks(batch.column("text")):
            elements, first, words = shingle_sets(data, offsets)
            sizes = np.diff(first)
            h1, h2 = sequence_hash(words, 2), sequence_hash(words, 3)
            # copies within a chunk share one computation
            _, where, which = np.unique(h1, return_index=True, return_inverse=True)
            where = where[sizes[where] > 0]
            regs = np.zeros((len(sizes), BANDS * ROWS), np.uint16)
            if len(where):
                each = sizes[where]
                spread = np.repeat(first[where], each) + (
                    np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                )
                some = sketch.registers(elements[spread], np.cumsum(each) - each, BANDS * ROWS)
                row = np.full(which.max() + 1, -1)
                row[which[where]] = np.arange(len(where))
                has = row[which] >= 0
                regs[has] = some[row[which][has]]
            keys = regs.reshape(len(sizes), BANDS, ROWS).astype(np.uint64)
            bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sizes), BANDS))
            for j in range(ROWS):
                bands = mix(bands * np.uint64(1 << 16) + keys[:, :, j] + np.uint64(j << 40))
            n_bands = np.where(sizes > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, len(sizes)).cast(pa.int64()),
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                    pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum(n_bands)]).astype(np.int32),
                        pa.array(bands[sizes > 0].reshape(-1).view(np.int64)),
                    ),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                names=["doc_id", "h1", "h2", "n_shingles", "bands", "regs"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: hashes of its word sequence, set size, band keys, registers."""
    return docs.select("doc_id", "text").mapInArrow(_signatures, SIGNATURE)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in text_chunks(batch.column("text")):
            elements, first, _ = shingle_sets(data, offsets)
            rows = [elements[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(lo, len(rows)), pa.array(rows, pa.binary())],
                names=["node", "elements"],
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("elements")]
            nodes = np.repeat(part.column("node").to_numpy(), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(np.concatenate(rows))], names=["node", "element"]
            )


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                for c in ("regs_a", "regs_b")
            )
            n_one, n_two = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            good = pa.array(sketch.jaccard(one, two, n_one, n_two) >= threshold)
            yield batch.select(["a", "b"]).filter(good)

    return run


def _in_common(one: pa.Array, two: pa.Array) -> list[tuple[int, int, int]]:
    """Sizes of two sets and of their intersection, pair by pair."""
    out = []
    for x, y in zip(one, two, strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
    return out


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([n for *_, n in _in_common(batch.column("set_a"), batch.column("set_b"))], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.select(["node", "centre"]).columns, x], names=["node", "centre", "x"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _in_common(batch.column("set_a"), batch.column("set_b"))
            good = [100 * both >= percent * (x + y - both) for x, y, both in sizes]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _other(df: DataFrame, node: str, names: dict[str, str]) -> DataFrame:
    return df.select(F.col("node").alias(node), *[F.col(c).alias(n) for c, n in names.items()])


class _Verifier:
    """Holds candidate pairs against sizes, registers, then whole sets."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.nodes, self.sets, self.percent = nodes.select("node", "n_shingles", "regs"), sets, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        sized = (
            pairs.join(_other(self.nodes, "a", {"n_shingles": "n_a", "regs": "regs_a"}), "a")
            .join(_other(self.nodes, "b", {"n_shingles": "n_b", "regs": "regs_b"}), "b")
            .filter(100 * small >= self.percent * large)
        )
        likely = sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(
            _likely(SURELY_BELOW), "a bigint, b bigint"
        )
        whole = likely.join(_other(self.sets, "a", {"elements": "set_a"}), "a").join(
            _other(self.sets, "b", {"elements": "set_b"}), "b"
        )
        return whole.select("a", "b", "set_a", "set_b").mapInArrow(
            _confirm(self.percent), "a bigint, b bigint"
        )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    ``component_id`` is the smallest id connected by links of at least ``percent`` / 100.
    """
    shared = Shared(docs.sparkSession, "near-dedup")
    numbered = signatures(docs).withColumn("row", F.monotonically_increasing_id())
    rows = shared.keep(numbered, "signatures")
    # one row stands for all copies of a text, rows that repeat included
    groups = (
        rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("node"), F.min_by("row", "doc_id").alias("row"))
    )
    nodes = shared.keep(
        rows.join(groups.select("h1", "h2", "row"), ["h1", "h2", "row"], "left_semi").select(
            F.col("doc_id").alias("node"), "n_shingles", "bands", "regs"
        ),
        "nodes",
    )
    bands = nodes.select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # members of bands with more than one text: far fewer rows than all bands
    members = shared.keep(bands.join(sizes, "band"), "members")
    involved = members.groupBy("node").agg(F.sum("_n").alias("degree"))
    texts = docs.select(F.col("doc_id").alias("node"), "text").filter("text is not null")
    sets = shared.keep(
        texts.join(involved, "node", "left_semi")
        .distinct()
        .mapInArrow(_sets, "node bigint, elements binary"),
        "sets",
    )
    facts = shared.keep(nodes.join(involved, "node").select("node", "degree", "n_shingles", "regs"), "facts")
    check = _Verifier(facts, sets, percent)
    ranked = members.select("band", "node").join(facts.select("node", "degree"), "node")

    links = shared.keep(check.links(_star(ranked)), "links-0")
    labels = components(links, shared, "components-0")
    mixed = shared.keep(_mixed(ranked, labels), "mixed")
    pairs = _across(mixed, facts, sets, percent)
    links = shared.keep(links.union(check.links(pairs)), "links-1")
    labels = components(links, shared, "components-1")

    named = groups.join(labels, "node", "left").select(
        "h1", "h2", F.coalesce("component", "node").alias("_component")
    )
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()),
    )


def _centres(members: DataFrame) -> DataFrame:
    """``band, centre``: the member that shares bands with most texts."""
    top = F.max(F.struct("degree", (-F.col("node")).alias("_minus"))).alias("_top")
    return members.groupBy("band").agg(top).select("band", (-F.col("_top._minus")).alias("centre"))


def _star(members: DataFrame) -> DataFrame:
    """Pairs of each band's centre with its other members."""
    return (
        members.select("band", "node")
        .join(_centres(members), "band")
        .filter("node <> centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )


def _mixed(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of bands that aren't connected yet, with their component and the band's centre."""
    marked = ranked.join(labels, "node", "left").select(
        "band", "node", "degree", F.coalesce("component", "node").alias("label")
    )
    bands = marked.groupBy("band").agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
    open_bands = bands.filter("_a < _b").select("band")
    return marked.join(open_bands, "band", "left_semi").join(_centres(ranked), "band")


def _across(mixed: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a band in different components, but for those that can't be links.

    Texts of one band have that band's centre in common, so they meet there, once for all
    their bands; texts of the centre's own component need no pairs among themselves.

    Elements that no other text of these bands holds are in no intersection; ``c`` are
    left of a text's ``n``.  Of those, ``x`` are shared with the band's centre.  Two texts
    have at most ``min(x)`` elements of the centre in common and ``min(c - x)`` others,
    and their similarity is at most that sum over ``n + n'`` less the sum.
    """
    inside = mixed.select("node").distinct()
    elements = sets.join(inside, "node", "left_semi").mapInArrow(_elements, "node bigint, element bigint")
    own = (
        elements.groupBy("element")
        .agg(F.min("node").alias("node"), F.max("node").alias("_last"))
        .filter("node = _last")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("_own"))
    )
    sized = (
        inside.join(facts.select("node", "n_shingles"), "node")
        .join(own, "node", "left")
        .select("node", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("_own", F.lit(0))).alias("c"))
        .filter(100 * F.col("c") >= percent * F.col("n"))
    )
    around = mixed.select("node", "label", "centre").distinct().join(sized, "node")
    near = (
        around.select("node", "centre")
        .join(_other(sets, "node", {"elements": "set_a"}), "node")
        .join(_other(sets, "centre", {"elements": "set_b"}), "centre")
        .select("node", "centre", "set_a", "set_b")
        .mapInArrow(_common, "node bigint, centre bigint, x bigint")
    )
    own_label = mixed.filter("node = centre").select("centre", F.col("label").alias("main")).distinct()
    placed = around.join(near, ["node", "centre"]).join(own_label, "centre", "left")
    fields = ("node", "label", "centre", "n", "c", "x")

    def side(df: DataFrame, k: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{k}") for c in fields])

    most = F.least("x_a", "x_b") + F.least(F.col("c_a") - F.col("x_a"), F.col("c_b") - F.col("x_b"))
    possible = (
        (F.col("label_a") != F.col("label_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
    )
    # a centre outside the open bands has no label there; then all are compared
    apart = F.col("main").isNull() | (F.col("label") != F.col("main"))
    left, right = side(placed.filter(apart), "a"), side(placed, "b")
    pairs = left.join(right, (F.col("centre_a") == F.col("centre_b")) & possible)
    return pairs.select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
    ).distinct()


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stand for their group, by their id; rows without id stay."""
    gone = near_duplicates(docs, percent).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def one_of_each_group(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id.

    Unlike in ``drop_near_duplicates``, rows that repeat id and text leave one, and rows without
    id are members of groups like others: one stays only if its group has no row with an id.
    Texts without words are in no group; of those, rows that repeat leave one.
    """
    # ids for rows without one: the same for equal texts, and behind real ids
    stand_in = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        F.coalesce(docs["doc_id"].cast("bigint"), stand_in).alias("id"),
        *[F.xxhash64(F.lit(k), docs["text"]).alias(f"h{k}") for k in (1, 2)],
    )
    found = near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text")), percent)
    gone = found.filter("not kept").select(F.col("doc_id").alias("_id")).distinct()
    left = rows.join(gone, F.col("id") == F.col("_id"), "left_anti")
    keys = ["id", "h1", "h2"]
    many = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = many.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = (F.col("id") == F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    first = left.join(again, same, "left_semi").dropDuplicates(keys)
    return left.join(again, same, "left_anti").unionByName(first).select("doc.*")
