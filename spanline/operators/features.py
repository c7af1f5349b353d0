"""Training sets and models: splits, jitter, sampling, features, outcome, smoothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.operators.joins import in_any_range
from spanline.ordered import GroupMax, Layout, RunSum, scan
from spanline.session import cut_lineage


def dictionary(vocab: DataFrame, label: str, out: str = "id") -> DataFrame:
    """Each distinct label with its place (from 0) among the sorted ones, for any number of labels.

    Labels are range-partitioned and sorted; a label's place is its place in its
    partition plus the sizes of the partitions ahead, one row each.  Null has no place.
    """
    values = vocab.select(label).filter(F.col(label).isNotNull()).distinct()
    spread = values.repartitionByRange(label).sortWithinPartitions(label)
    placed = cut_lineage(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    # one row a partition
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(label, place.alias(out))


def label_index(df: DataFrame, label: str, vocab: DataFrame, out: str = "label_id") -> DataFrame:
    """Position of each label in its sorted vocabulary; a label outside it is an error."""
    ids = dictionary(vocab, label, "_id").withColumnRenamed(label, "_label")
    strict = F.when(F.col("_id").isNotNull(), F.col("_id")).otherwise(
        F.raise_error(
            F.concat(F.lit("label outside the vocabulary: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
        ).cast("bigint")
    )
    return df.join(ids, F.col(label) == F.col("_label"), "left").withColumn(out, strict.cast("int")).drop("_id", "_label")


def split_train_val(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    frac: float = 0.8,
    seed: int = 0,
    layout: Layout | None = None,
) -> DataFrame:
    """Mark exactly ``floor(frac * n)`` rows of each key as ``train``, chosen by hash order."""
    layout = layout or Layout.inspect(df, keys)
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(seed))))
    order = ["_h", id_col]
    ranked = scan(hashed, keys, order, {"_rn": RunSum(F.lit(1))}, layout, True)
    sized = scan(ranked, keys, order, {"_n": GroupMax("_rn")}, layout)
    return (
        sized.withColumn(
            "split", F.when(F.col("_rn") <= F.floor(F.col("_n") * frac), "train").otherwise("val")
        )
        .drop("_h", "_rn", "_n")
    )


def jitter_variants(df: DataFrame, id_col: str, n: int, d: int, seed: int = 0) -> DataFrame:
    """``n`` distinct offsets ``(dx, dy)`` within ``d`` per sample, chosen by hash order."""
    offsets = [(x, y) for x in range(-d, d + 1) for y in range(-d, d + 1)]
    if n > len(offsets):
        raise ValueError("more variants than offsets")
    grid = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in offsets])
    keyed = F.transform(
        grid,
        lambda o: F.struct(
            F.md5(F.concat_ws("|", F.col(id_col).cast("string"), o["dx"], o["dy"], F.lit(seed))).alias("h"),
            o["dx"].alias("dx"),
            o["dy"].alias("dy"),
        ),
    )
    return df.withColumn("_o", F.explode(F.slice(F.array_sort(keyed), 1, n))).select(
        *df.columns, "_o.dx", "_o.dy"
    )


def adaptive_sample(
    grid: DataFrame,
    dense: DataFrame,
    keys: Sequence[str],
    every: int,
    layout: Layout | None = None,
) -> DataFrame:
    """All ticks inside dense ranges, every ``every``-th one elsewhere."""
    inside = in_any_range(grid, dense, keys, "t", layout)
    return inside.unionByName(grid.filter(F.pmod("tick", F.lit(every)) == 0)).distinct()


def match_features(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str], label: str
) -> tuple[PipelineModel, DataFrame]:
    """Index and one-hot the categories, append the numbers, index the label."""
    stages = [
        StringIndexer(
            inputCols=[*categories, label],
            outputCols=[*[f"{c}_i" for c in categories], "label"],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories]
        ),
        VectorAssembler(
            inputCols=[*[f"{c}_v" for c in categories], *numbers], outputCol="features"
        ),
    ]
    model = Pipeline(stages=stages).fit(df)
    return model, model.transform(df)


def outcome_classifier(
    df: DataFrame, id_col: str, classes: int, seed: int = 0, hidden: int = 8, rounds: int = 20
) -> DataFrame:
    """Train on nine tenths of the rows and report accuracy on the last tenth (by hash)."""
    digest = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(seed)))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10
    train, val = df.filter(bucket != 0), df.filter(bucket == 0)
    width = df.select("features").first()[0].size
    net = MultilayerPerceptronClassifier(
        layers=[width, hidden, classes], maxIter=rounds, seed=seed, featuresCol="features"
    )
    scored = net.fit(train).transform(val)
    return scored.agg(
        F.count(F.lit(1)).alias("n_val"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
    )


def viterbi_smooth(
    scores: DataFrame,
    trans: np.ndarray,
    init: np.ndarray,
    keys: Sequence[str],
    t: str = "t",
    scores_col: str = "scores",
    block: int = 20_000,
    fan: int = 1_000,
    layout: Layout | None = None,
) -> DataFrame:
    """Most likely label path per timeline, from per-sample log scores.

    The path is a product of (max, +) matrices, which is associative: timelines are
    cut into blocks of ``block`` samples, each block gives one small matrix from
    entry to exit state, the matrices of a timeline are chained to fix the state at
    every block border, and each block then traces its own path.  No task holds
    more than a block of samples or a few thousand small matrices.
    ``trans`` and ``init`` are log probabilities; ties take the lowest state.
    """
    from spanline.operators.folds import timeline_fold
    from spanline.operators.intervals import chunk_sequences

    keys = list(keys)
    layout = layout or Layout.inspect(scores, keys)
    k = len(init)
    trans = np.asarray(trans, dtype=float)
    init = np.asarray(init, dtype=float)
    types = {c: scores.schema[c].dataType.simpleString() for c in [*keys, t]}
    key_ddl = [f"{c} {types[c]}" for c in keys]
    df = chunk_sequences(scores.select(*keys, t, scores_col), keys, [t], block, layout)

    def steps(rows: list[dict], first: bool, tracing: bool):
        """The entry-to-exit matrix; with ``tracing`` also the (k, k) best predecessors per sample."""
        obs = np.asarray([r[scores_col] for r in rows], dtype=float)
        if first:
            best = np.where(np.eye(k, dtype=bool), init[None, :] + obs[0][None, :], -np.inf)
            # a timeline's first sample has no predecessor: entry state is its own state
            back = [np.tile(np.arange(k), (k, 1))]
            start = 1
        else:
            best = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
            back, start = [], 0
        for o in obs[start:]:
            cand = best[:, :, None] + trans[None, :, :]
            if tracing:
                back.append(cand.argmax(axis=1))
            best = cand.max(axis=1) + o[None, :]
        return best, back

    def whole(fn: Callable[[list[dict]], list[dict]]):
        """Blocks have a fixed number of rows, so they are folded as lists."""
        return lambda rows: fn(list(rows))

    def matrix(rows: list[dict]) -> list[dict]:
        best, _ = steps(rows, rows[0]["chunk"] == 0, False)
        head = {c: rows[0][c] for c in keys}
        return [dict(head, chunk=rows[0]["chunk"], m=[float(x) for x in best.ravel()])]

    ddl = ", ".join([*key_ddl, "chunk bigint", "m array<double>"])
    blocks = timeline_fold(df, [*keys, "chunk"], [t], whole(matrix), ddl)

    def product(rows: list[dict]) -> list[dict]:
        total = np.asarray(rows[0]["m"]).reshape(k, k)
        for r in rows[1:]:
            total = (total[:, :, None] + np.asarray(r["m"]).reshape(k, k)[None]).max(axis=1)
        head = {c: rows[0][c] for c in keys}
        return [dict(head, chunk=rows[0]["wide"], m=[float(x) for x in total.ravel()])]

    def chain(rows: list[dict]) -> list[dict]:
        """Entry and exit state of each matrix; ends in ``leave`` of ``rows`` if they have it."""
        fixed = "entry" in rows[0]
        mats = [np.asarray(r["m"]).reshape(k, k) for r in rows]
        first = mats[0][rows[0]["entry"]][None, :] if fixed else mats[0]
        score, entry_of = first.max(axis=0), [first.argmax(axis=0)]
        for m in mats[1:]:
            cand = score[:, None] + m
            entry_of.append(cand.argmax(axis=0))
            score = cand.max(axis=0)
        state = rows[0]["leave"] if fixed else int(score.argmax())
        out = []
        for n in range(len(rows) - 1, -1, -1):
            before = rows[0]["entry"] if fixed and n == 0 else int(entry_of[n][state])
            head = {c: rows[n][c] for c in keys}
            out.append(dict(head, chunk=rows[n]["chunk"], entry=before, leave=state))
            state = before
        return out

    ends = ", ".join([*key_ddl, "chunk bigint", "entry int", "leave int"])
    if layout.split:
        # long timelines: multiply a thousand blocks at a time, chain the products,
        # then fix the borders inside each product
        blocks = cut_lineage(blocks.withColumn("wide", F.floor(F.col("chunk") / fan)))
        wide = timeline_fold(blocks, [*keys, "wide"], ["chunk"], whole(product), ddl)
        outer = timeline_fold(wide, keys, ["chunk"], whole(chain), ends)
        outer = outer.withColumnRenamed("chunk", "wide")
        inner = blocks.join(outer, [*keys, "wide"])
        borders = timeline_fold(inner, [*keys, "wide"], ["chunk"], whole(chain), ends)
    else:
        borders = timeline_fold(blocks, keys, ["chunk"], whole(chain), ends)

    def trace(rows: list[dict]) -> list[dict]:
        entry, state = rows[0]["entry"], rows[0]["leave"]
        _, back = steps(rows, rows[0]["chunk"] == 0, True)
        path = []
        for row, b in zip(reversed(rows), reversed(back), strict=True):
            path.append(dict({c: row[c] for c in keys}, **{t: row[t]}, state=state))
            state = int(b[entry][state])
        return path[::-1]

    ddl = ", ".join([*key_ddl, f"{t} {types[t]}", "state int"])
    known = df.join(borders, [*keys, "chunk"])
    return timeline_fold(known, [*keys, "chunk"], [t], whole(trace), ddl)


def score_batches(
    df: DataFrame,
    models: dict[str, np.ndarray],
    by: str,
    id_col: str,
    vector: str,
    base: str = "base",
    max_model_bytes: int = 256 * 1024 * 1024,
) -> DataFrame:
    """Index of the best class per row, with the model of the row's mode or the base one.

    A model is a matrix of class weights (class x dimension); models travel with
    the task and rows are scored in Arrow batches.  A vector that is null or holds a null
    has neither class nor score.
    """
    size = sum(np.asarray(w).nbytes for w in models.values())
    if size > max_model_bytes:
        raise ValueError(f"models of {size} bytes are too large to ship with every task")
    shared = df.sparkSession.sparkContext.broadcast(
        {m: np.asarray(w, dtype=float) for m, w in models.items()}
    )
    id_type = df.schema[id_col].dataType.simpleString()
    def run(batches):
        weights = shared.value
        for batch in batches:
            modes = np.asarray(batch.column(by).to_pylist(), dtype=object)
            if not batch.num_rows:
                continue
            column = batch.column(vector)
            values, offsets = column.values, column.offsets.to_numpy()
            nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            whole = column.is_valid().to_numpy(zero_copy_only=False) & (nulls[offsets[1:]] == nulls[offsets[:-1]])
            best = np.zeros(batch.num_rows, dtype=np.int32)
            score = np.zeros(batch.num_rows)
            for mode in set(modes.tolist()):
                w = weights.get(mode, weights[base])
                own = np.flatnonzero(whole & (modes == mode))
                if (np.diff(offsets)[own] != w.shape[1]).any():
                    raise ValueError(f"vectors of mode {mode} have other sizes than their model")
                place = offsets[:-1][own][:, None] + np.arange(w.shape[1])
                x = values.take(pa.array(place.reshape(-1))).to_numpy(zero_copy_only=False).astype(float)
                s = x.reshape(len(own), w.shape[1]) @ w.T
                best[own], score[own] = s.argmax(axis=1), s.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(best, mask=~whole), pa.array(score, mask=~whole)],
                names=[id_col, "best", "score"],
            )

    return df.select(id_col, by, vector).mapInArrow(
        run, f"{id_col} {id_type}, best int, score double"
    )

