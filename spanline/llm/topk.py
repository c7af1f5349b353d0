"""Exact top-k by inner product: branch and bound over blocks of dimensions.

Queries travel to the candidates, in blocks of at most ``BLOCK_BYTES``, so candidates are never
shuffled; a further block of queries is a further pass over the candidates.  Each query
carries a bound from a first look at a bounded sample of the candidates: its k-th best
score there, which none of its results can fall short of.

A task holds candidates by dimension, ``CANDIDATES`` at a time.  For each query, scores are
summed block of dimensions by block; what the rest can add at most is the product of the
remaining norms (Cauchy and Schwarz).  Candidates whose bound lies below the query's, or
below the k-th best sure score, are compacted away.  Survivors of the last block have
their exact score.  Only a task's ``k`` best a query leave it, to be ranked over all tasks.

Components are ``floor(scale * x)`` as integers.  Vectors that are null, empty or hold null
or non-finite components take no part; shorter ones count as filled up with zeros.
Components and scores beyond 64 bits count as the largest or smallest number of 64 bits.
Repeated candidate rows each take a rank; repeated query rows are asked once.  Without
queries or candidates the result is empty.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm.common import Shared, running_total

#: Rows of a task's block of candidates, dimensions of a step, bytes of a block of queries or of the sample.
CANDIDATES, DIMENSIONS, BLOCK_BYTES = 8192, 16, 16 << 20
LARGEST = 2**63 - 1


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """``id, v`` of the rows that take part, ``v`` an array of integers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", bad)
    ).select("id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _widest(column: pa.Array) -> int:
    return int(np.diff(column.offsets.to_numpy()).max(initial=1))


class Block:
    """Candidates by dimension, with norms of what is left after each block of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.cuts = ids, [*range(0, vectors.shape[1], DIMENSIONS), vectors.shape[1]]
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(0), kind="stable")
        self.columns = np.ascontiguousarray(vectors[:, self.order].T.astype(np.float64))
        self.largest = float(np.abs(self.columns).max(initial=0))
        self.whole = vectors
        self.rest = [np.sqrt((self.columns[c:] ** 2).sum(0)) for c in self.cuts]

    def best(self, query: int, q: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best, ties to the smaller id; those below ``least`` may be left out."""
        alive = np.flatnonzero(self.ids != query)
        if np.abs(q.astype(np.float64)).max(initial=0) * self.largest * len(q) < 2**52:
            q = q[self.order].astype(np.float64)
            score = np.zeros(len(alive))
            for lo, hi, rest in zip(self.cuts[:-1], self.cuts[1:], self.rest[1:], strict=True):
                score += q[lo:hi] @ (self.columns[lo:hi] if len(alive) == len(self.ids) else self.columns[lo:hi, alive])
                slack = rest[alive] * np.sqrt((q[hi:] ** 2).sum()) * (1 + 1e-9)
                sure = least
                if len(alive) > k:
                    sure = max(sure, np.partition(score - slack, len(alive) - k)[len(alive) - k])
                stay = score + slack >= sure
                alive, score = alive[stay], score[stay]
            score = score.astype(np.int64)
        else:  # beyond what doubles hold exactly: integers of any size
            score = self.whole[alive].astype(object) @ q.astype(object)
            score = np.array([min(max(x, -LARGEST - 1), LARGEST) for x in score], np.int64)
        first = np.lexsort((self.ids[alive], _falling(score)))[:k]
        return self.ids[alive][first], score[first]


def _falling(score: np.ndarray) -> np.ndarray:
    """A key that falls as ``score`` rises; the smallest number has no negative."""
    return ~score


class _Asked:
    """One block of queries, with the bound that each carries."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.ids = rows.column("id").to_numpy()
        self.vectors = rows.column("v").chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        self.least = rows.column("least").to_numpy()
        self.width = _widest(self.vectors)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Block, int]]:
    held: list[pa.RecordBatch] = []
    n = 0

    def block() -> tuple[Block, int]:
        rows = pa.Table.from_batches(held).combine_chunks()
        column = rows.column("v").chunk(0)
        wide = max(width, _widest(column))
        return Block(rows.column("id").to_numpy(), _matrix(column, wide)), wide

    for batch in batches:
        for lo in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(lo, CANDIDATES)
            if n and n + part.num_rows > CANDIDATES:
                yield block()
                held, n = [], 0
            held, n = [*held, part], n + part.num_rows
    if n:
        yield block()


def _search(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = asked.value
        ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(of.ids)
        scores = list(ids)
        for block, width in _blocks(batches, of.width):
            for n, q in enumerate(_matrix(of.vectors, width)):
                least = max(of.least[n], float(scores[n][-1]) if len(scores[n]) >= k else -np.inf)
                new, score = block.best(of.ids[n], q, k, least)
                if len(new):
                    new, score = np.concatenate([ids[n], new]), np.concatenate([scores[n], score])
                    first = np.lexsort((new, _falling(score)))[:k]
                    ids[n], scores[n] = new[first], score[first]
        if len(of.ids):
            query = np.repeat(of.ids, [len(x) for x in ids])
            columns = [query, np.concatenate(ids), np.concatenate(scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _bounds(sample, k: int):
    """Adds ``least``, a little below the k-th best score within the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        for batch in batches:
            column, ids = batch.column("v"), batch.column("id").to_numpy()
            width = max(_widest(column), sample.value[2])
            if width not in blocks:
                blocks[width] = Block(sample.value[0], _matrix(sample.value[1], width))
            least = np.full(len(ids), -np.inf)
            for n, q in enumerate(_matrix(column, width)):
                scores = blocks[width].best(ids[n], q, k)[1]
                if len(scores) == k:
                    least[n] = np.nextafter(float(scores[-1]), -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for tables of ``id, v``; a query's own id is no candidate."""
    spark = queries.sparkSession
    shared = Shared(spark, "top-k")
    rows = candidates.select(F.col("id").cast("bigint").alias("id"), "v")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    wide = max(n and width, queries.agg(F.max(F.size("v"))).first()[0] or 1)
    each = max(1, block_bytes // (8 * wide))
    drawn = F.pmod(F.xxhash64("id"), F.lit(max(1, n // CANDIDATES))) == 0
    few = rows.filter(drawn).limit(min(each, CANDIDATES)).toArrow().combine_chunks()
    vectors = few.column("v").chunk(0) if few.num_rows else pa.array([], pa.list_(pa.int64()))
    sample = spark.sparkContext.broadcast((few.column("id").to_numpy(), vectors, _widest(vectors)))
    asked = shared.keep(queries.select(F.col("id").cast("bigint").alias("id"), "v").distinct(), "asked")
    place = running_total(asked, [], F.pmod(F.xxhash64("id"), F.lit(256)), ["id", "v"], F.lit(1).cast("bigint"), "place")
    bounded = place.select("id", "v", F.floor(F.col("place") / each).alias("block")).mapInArrow(
        _bounds(sample, k), "id bigint, v array<bigint>, block bigint, least double"
    )
    bounded = shared.keep(bounded, "bounded")
    shape = "query_id bigint, vec_id bigint, score bigint"
    found = spark.createDataFrame([], shape)
    # one number a block
    for r in bounded.select("block").distinct().orderBy("block").collect():
        part = bounded.filter(F.col("block") == r["block"]).select("id", "v", "least").toArrow()
        block = spark.sparkContext.broadcast(_Asked(part))
        found = found.union(shared.keep(rows.mapInArrow(_search(block, k), shape), f"found-{r['block']}"))
        block.unpersist()
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", "score").filter(
        F.col("rank") <= k
    )
