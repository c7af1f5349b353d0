"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import CLASH

from spanline.llm.embedding_dedup import drop_near_vectors, near_vectors

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def odd_vectors():
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in ("a", "b", None):
        base = rng.standard_normal((30, 24))
        for copies, x in zip([40, 25, *[1] * 28], base, strict=True):
            for _ in range(copies):
                y = (x + rng.standard_normal(24) * rng.uniform(0.02, 0.2)) * rng.uniform(0.1, 9)
                rows.append((k, y.tolist(), label))
                k += 1
    hot = base[0].tolist()
    rows += [(k + i, hot, "a") for i in range(30)] + [rows[0], rows[0], (7, rows[50][1], "a"), (None, rows[1][1], "a"), (None, None, None)]
    k += 100
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, math.nan], [1.0, math.inf], [1e300, 1.0], [1e300, 2e290], [1e-310, 0.0], [0.98, math.sqrt(1 - 0.98**2)], [-1.0, 0.0], [5.0], [2.0], [-0.0, -0.0]]
    rows += [(k + i, v, label) for i, (v, label) in enumerate((v, label) for v in odd for label in ("a", "b"))]
    return rows


def plain(rows, cosine):
    """Rows as vertices; those that repeat id, label and vector are one."""
    def fit(r):
        i, v, label = r
        return i is not None and label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    keys = sorted({(i, label, tuple(v)) for i, v, label in rows if fit((i, v, label))})
    def unit(v):
        x = np.array(v) / max(map(abs, v))
        return x / np.sqrt((x * x).sum())
    units = [unit(k[2]) for k in keys]
    links = [[] for _ in keys]
    for a in range(len(keys)):
        for b in range(a):
            if keys[a][1] == keys[b][1] and len(keys[a][2]) == len(keys[b][2]) and units[a] @ units[b] >= cosine:
                links[a].append(b)
                links[b].append(a)
    least = [k[0] for k in keys]
    while True:
        new = [min([least[a], *(least[b] for b in links[a])]) for a in range(len(keys))]
        if new == least:
            break
        least = new
    facts = {k: (len(links[a]), least[a]) for a, k in enumerate(keys)}
    out = []
    for r in rows:
        n, own = facts[r[0], r[2], tuple(r[1])] if fit(r) else (0, r[0])
        out.append(str((r[0], n, own, r[0] == own)))
    return sorted(out)


@pytest.mark.parametrize(("block", "cell"), [(4096, 1 << 14), (8, 16)])
def test_like_all_pairs(spark, block, cell):
    rows = odd_vectors()
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in [*CLASH, "bucket", "links", "h1", "n"]}).repartition(5)
    got = near_vectors(df, df.columns, block=block, cell=cell)
    assert sorted(str(tuple(r)) for r in got.select("doc.vec_id", "n_links", "component_id", "kept").collect()) == plain(rows, 0.98)
    assert got.filter("doc.kept = 1 and doc.bucket = 1").count() == len(rows)


def test_other_thresholds_and_no_rows(spark):
    rows = odd_vectors()[:120]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_vectors(df, ["vec_id"], cosine=0.995).select("doc.vec_id", "n_links", "component_id", "kept")
    want = plain(rows, 0.995)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert near_vectors(df.filter("vec_id < 0"), ["vec_id"]).count() == 0
    left = drop_near_vectors(df.withColumn("label", F.lit(3)), cosine=0.9)
    assert left.columns == df.columns and 0 < left.count() < len(rows)
