"""Large tables are dealt to tasks of a bounded number of rows; chains of lookups stay short."""

import os

import pytest
from pyspark.sql import functions as F

from spanline import ordered
from spanline.catalog import load, plan_queries
from spanline.catalog.registry import QUERIES
from spanline.operators import intervals, joins
from spanline.ordered import Layout, Prev, scan
from spanline.plans import annotate, samples
from spanline.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 5)


def steps(spark, n):
    return spark.range(n).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_rows(spark, few_rows):
    cores = spark.sparkContext.defaultParallelism
    assert ordered.tasks_for(spark, 5 * cores) == 0
    assert ordered.tasks_for(spark, 10 * cores) == 2 * cores
    df = steps(spark, 20 * cores)
    layout = Layout.inspect(df, ["k"])
    assert not layout.split and layout.tasks == 4 * cores
    done = scan(df, ["k"], ["t"], {"p": Prev("t")}, layout)
    assert done.rdd.getNumPartitions() == 4 * cores
    plain = scan(df, ["k"], ["t"], {"p": Prev("t")}, Layout(False))
    assert sorted(done.collect()) == sorted(plain.collect())


def test_chain_is_dealt_once(spark, few_rows):
    df = steps(spark, 400).withColumn("label", (F.col("t") % 3).cast("string"))
    layout = Layout.inspect(df, ["k"])
    iv = intervals.run_length_encode(df, ["k"], "t", "label", (), layout)
    hit = joins.state_at(iv, iv.select("k", "b", "e", "status"), ["k"], "b", out="s", layout=layout)
    # one exchange of each encoding, none of their union
    assert plan(hit).count("Exchange hashpartitioning") <= 2


def test_grid_stays_in_place(spark, few_rows):
    day = 24 * 3_600_000_000
    seqs = spark.createDataFrame([(1, 0, day), (2, 0, 2 * day), (None, 0, day)], "g long, b long, e long")
    truth = spark.createDataFrame(
        [(1, "x", 0, day // 2, "u"), (1, "x", day // 2 + 1, day, "v"), (1, "y", 3_700_000_000, day, "w"),
         (None, "y", 3_700_000_000, day, "n")],
        "g long, attr string, b long, e long, status string",
    )
    out = samples.samples_from_truth(seqs, truth, "g", ["x", "y"], 3_600_000_000, trim_us=100_000_000).drop("split")
    assert "Join" not in plan(out)  # the grid was joined to begins, then pivoted
    rows = {(r.g, r.t): (r.x, r.y) for r in out.collect()}
    assert rows[1, 100_000_000] == ("u", "w")
    assert rows[1, 100_000_000 + 20 * 3_600_000_000] == ("v", "w")
    assert (1, 3_700_000_000) not in rows and rows[None, 3_700_000_000] == ("n/a", "n")
    assert rows[2, 100_000_000] == ("n/a", "n/a")


def test_repeated_points_count_once(spark):
    grid = spark.createDataFrame([(1, 5), (1, 5), (1, None), (1, None), (1, 9)], "g int, t long")
    iv = spark.createDataFrame([(1, "x", 0, 5, "u"), (1, "x", 5, 8, "v")], "g int, attr string, b long, e long, status string")
    got = joins.label_grid(grid, iv, ["g"], ["x"]).collect()
    assert sorted(map(str, got)) == sorted(
        ["Row(g=1, t=5, x='v')", "Row(g=1, t=None, x='u')", "Row(g=1, t=9, x='v')"]
    )


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_suppressed_lifecycles_store_their_states(spark):
    load()
    out = QUERIES["w30_lifecycle_suppressed"](spark, SF)
    assert plan(out).count("Window [") <= 20


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_rounds_are_encoded_once(spark, monkeypatch):
    calls, own = [], annotate.clean_timelines
    monkeypatch.setattr(annotate, "clean_timelines", lambda *a: calls.append(1) or own(*a))
    plan_queries.round_states(spark, SF)
    assert len(calls) == 1


def test_docs_compressed(spark, tmp_path):
    docs = spark.range(2000).select("id", F.array(F.struct(F.lit("name").alias("n"))).alias("g"))
    path = str(tmp_path / "docs")
    sinks.write_docs(docs, path, "gzip")
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert spark.read.json(path).count() == 2000
