"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors are compared within a label.  Normalised, two vectors of cosine ``c`` lie
``sqrt(2 - 2c)`` apart.  ``TABLES`` tables each quantise ``HASHES`` Gaussian projections in
steps of ``STEP`` such distances (10 for c = 0.98); two vectors are candidates if all
numbers of a table agree.  At the threshold itself a projection agrees with probability
0.920, so a pair is missed with (1 - 0.920^18)^64, 1e-7; closer ones with less.

1. Equal vectors of a label form a *class*; a class of any size is one row from there on.
2. Classes that share a bucket meet in *cells*: small buckets are packed into cells of a
   bounded number of rows; a bucket of more than ``BLOCK`` classes is cut into blocks, and
   each pair of blocks is a cell.  A cell multiplies its vectors and gives, for each class,
   the number of its links and one class that it is connected with in that cell; pairs
   leave no cell.  A pair counts in the first table in which it meets, and there alone.
3. Those connections are joined into components.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a
null label, link with nothing and stand for themselves.  Vectors of unequal length link
with nothing.  Rows that repeat id, label and vector count once as partners; rows that share
only the id count as different vectors.  Rows with a null id are no partners and have no
component (``kept`` is true).  An empty table gives an empty result.  Labels and vectors are
told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.llm.bytewords import mix
from spanline.llm.common import Shared
from spanline.llm.components import components

HASHES, TABLES, STEP = 18, 64, 10.0
#: Classes of a block, rows of a cell of small buckets.
BLOCK, CELL = 4096, 1 << 14
#: Around the threshold, cosines are computed once more, without normalising first.
UNSURE = 1e-9


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _projections(width: int, hashes: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and offsets, the same in every task."""
    rng = np.random.Generator(np.random.PCG64([20040608, width]))
    return rng.standard_normal((width, hashes * tables)), rng.random(hashes * tables)


def _hash_vectors(cosine: float, hashes: int, tables: int, step: float):
    side = step * sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                values, sizes = _lists(part.column("v"))
                first = np.concatenate([[0], np.cumsum(sizes)])
                out = np.zeros((part.num_rows, tables), np.uint64)
                for width in np.unique(sizes).tolist():
                    if width not in known:
                        known[width] = _projections(width, hashes, tables)
                    directions, shift = known[width]
                    rows = np.flatnonzero(sizes == width)
                    x = _unit(values[first[rows][:, None] + np.arange(width)])
                    at = np.floor(x @ directions / side + shift).astype(np.int64).view(np.uint64)
                    at = at.reshape(len(rows), tables, hashes)
                    key = np.full((len(rows), tables), width, np.uint64)
                    for j in range(hashes):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + at[:, :, j])
                    out[rows] = key
                # 32 bits a table tell first meetings; the bucket adds label and table
                out >>= np.uint64(32)
                label = part.column("label").to_numpy().view(np.uint64)[:, None]
                numbers = np.arange(tables, dtype=np.uint64)[None, :]
                buckets = mix(mix(label + numbers) + out)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        pa.ListArray.from_arrays(
                            np.arange(0, out.size + 1, tables, dtype=np.int32), pa.array(buckets.reshape(-1).view(np.int64))
                        ),
                        pa.array([r.tobytes() for r in out.astype(np.uint32)], pa.binary()),
                    ],
                    names=["node", "buckets", "sig"],
                )

    return run


def _linked(x: np.ndarray, y: np.ndarray, cosine: float, below: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` and ``y`` with at least that cosine; ``below``: of one table, each pair once."""
    ux, uy = _unit(x), _unit(y)
    left, right = [], []
    for lo in range(0, len(x), 512):
        got = ux[lo : lo + 512] @ uy.T
        i, j = np.nonzero(got >= cosine - UNSURE)
        near = got[i, j] < cosine + UNSURE
        i = i + lo
        if near.any():
            a, b = x[i[near]], y[j[near]]
            a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
            sure = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)) >= cosine
            stay = np.ones(len(i), bool)
            stay[near] = sure
            i, j = i[stay], j[stay]
        if below:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places, the least one it is connected with by pairs ``(i, j)``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(cosine: float):
    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        place = np.lexsort((cell.column("side").to_numpy(), cell.column("bucket").to_numpy()))
        bucket, side = (cell.column(c).to_numpy()[place] for c in ("bucket", "side"))
        node, label, many, table = (cell.column(c).to_numpy()[place] for c in ("node", "label", "n", "table"))
        column = cell.column("v").chunk(0)
        values, sizes = _lists(column)
        first = (np.cumsum(sizes) - sizes)[place]
        sizes = sizes[place]
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint32).reshape(len(place), -1)[place]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        one = cell.column("one")[0] == cell.column("two")[0]  # whole buckets, or a block with itself
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            middle = lo + int(np.searchsorted(side[lo:hi], 1))
            a, b = np.arange(lo, middle), np.arange(lo, hi) if one else np.arange(middle, hi)
            if not len(a) or not len(b) or sizes[lo:hi].min() != sizes[lo:hi].max():
                continue  # vectors of unequal length share a bucket by chance only
            wide = np.arange(sizes[lo])
            x = values[first[a][:, None] + wide]
            i, j = _linked(x, x if one else values[first[b][:, None] + wide], cosine, one)
            i, j = a[i], b[j]
            t = int(table[lo])
            new = (sig[i, t] == sig[j, t]) & (label[i] == label[j])
            i, j = i[new], j[new]
            for before in range(t):
                if not len(i):
                    break
                new = sig[i, before] != sig[j, before]
                i, j = i[new], j[new]
            if len(i):
                links = np.bincount(i - lo, many[j], hi - lo) + np.bincount(j - lo, many[i], hi - lo)
                some = np.flatnonzero(links)
                out.append((node[lo + some], links[some].astype(np.int64), node[lo + _least_labels(hi - lo, i - lo, j - lo)[some]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("node", "links", "least"), columns, strict=True)})

    return run


def _comparable(label: Column, x: Column) -> Column:
    bad = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda y: y != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame,
    keep: list[str],
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.98,
    hashes: int = HASHES,
    tables: int = TABLES,
    block: int = BLOCK,
    cell: int = CELL,
) -> DataFrame:
    """``doc`` (struct of the ``keep`` columns), ``n_links``, ``component_id``, ``kept`` for each row.

    ``hashes`` should grow by one when the rows of a label grow by half, to keep chance meetings
    rare; ``tables`` then by a tenth, to keep the share of missed pairs.
    """
    shared = Shared(vectors.sparkSession, "near-vectors")
    x = vectors[vector].cast("array<double>")
    part = _comparable(vectors[label], x) & vectors[id_col].isNotNull()
    h = [F.when(part, F.xxhash64(F.lit(k), vectors[label], x)) for k in (1, 2)]
    rows = vectors.select(
        F.struct(*[vectors[c] for c in keep]).alias("doc"),
        vectors[id_col].cast("bigint").alias("id"),
        F.when(part, F.xxhash64(vectors[label])).alias("label"),
        F.when(part, x).alias("v"),
        h[0].alias("h1"),
        h[1].alias("h2"),
    )
    same = rows.filter("h1 is not null").groupBy("h1", "h2", "id").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    classes = shared.keep(
        same.groupBy("h1", "h2")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    hashed = shared.keep(
        classes.select("node", "label", "v").mapInArrow(
            _hash_vectors(cosine, hashes, tables, STEP), "node bigint, buckets array<bigint>, sig binary"
        ),
        "hashed",
    )
    found = hashed.select("node", F.posexplode("buckets").alias("table", "bucket"))
    full = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = shared.keep(found.join(full, "bucket"), "members")
    met = _cells(members, block, cell).join(classes.select("node", "label", "n", "v"), "node").join(hashed.select("node", "sig"), "node")
    links = shared.keep(
        met.groupBy("cell", "one", "two").applyInArrow(_meet(cosine), "node bigint, links bigint, least bigint"), "links"
    )
    shared.drop("members", "hashed")
    edges = links.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    labels = components(edges, shared, "components").select(F.col("node").alias("_node"), "component")
    counts = links.groupBy(F.col("node").alias("_with")).agg(F.sum("links").alias("links"))
    named = shared.keep(
        classes.select("h1", "h2", "node", "id", "n")
        .join(labels, F.col("node") == F.col("_node"), "left")
        .join(counts, F.col("node") == F.col("_with"), "left")
        .select(
            F.col("h1").alias("_h1"),
            F.col("h2").alias("_h2"),
            "id",
            F.coalesce("component", "node").alias("component"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        ),
        "named",
    )
    least = named.groupBy(F.col("component").alias("_component")).agg(F.min("id").alias("least"))
    facts = named.join(least, F.col("component") == F.col("_component")).select("_h1", "_h2", "links", "least")
    own = F.coalesce("least", "id")
    return (
        rows.select("doc", "id", "h1", "h2")
        .join(facts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
        .select(
            "doc",
            F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
            own.alias("component_id"),
            F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
        )
    )


def _cells(members: DataFrame, block: int, cell: int) -> DataFrame:
    """Where members meet: ``cell``, ``one``, ``two``, and ``side`` (1: the second block of a pair)."""
    parts = max(
        ceil(members.filter(F.col("size") <= block).count() / cell),
        int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    small = members.filter(F.col("size") <= block).select(
        "node", "table", "bucket", F.pmod("bucket", F.lit(parts)).alias("cell"),
        F.lit(-1).alias("one"), F.lit(-1).alias("two"), F.lit(0).alias("side"),
    )
    blocks = F.ceil(F.col("size") / block)
    own = members.filter(F.col("size") > block).select(
        "node", "table", "bucket", blocks.cast("int").alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
    )
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = other.select(
        "node", "table", "bucket", F.col("bucket").alias("cell"),
        F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    return small.union(large)


def drop_near_vectors(vectors: DataFrame, **options) -> DataFrame:
    """The rows of ``vectors`` that stand for their component, by their id."""
    return near_vectors(vectors, vectors.columns, **options).filter("kept").select("doc.*")
