"""Publication by id under failing and retried tasks; one-pass routing."""

from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanline.sources import sinks
from spanline.sources.publish import RELEASED, FolderService, publish_documents


def failing(path, always):
    """A service that fails in the middle of one object: once, or every time.

    The class is local, so that it travels to the tasks by value.
    """

    class Failing(FolderService):
        def put(self, run, name, docs):
            seen = Path(self.root) / "failed"
            if name.endswith("1") and (always or not seen.exists()):
                seen.touch()
                FolderService.put(self, run, name, (next(docs) for _ in range(2)))
                raise OSError("connection lost")
            return FolderService.put(self, run, name, docs)

    return Failing(str(path))


def _docs(spark, n=1_000):
    ids = spark.range(n).select("id", F.to_json(F.struct("id", F.col("id") * 3)).alias("doc"))
    return ids.unionByName(ids.filter("id % 10 = 0"))  # repeated rows


def _read(spark, service, run):
    return Counter(json.loads(r["doc"])["id"] for r in service.read(spark, run).collect())


def test_each_id_once(spark, tmp_path):
    service = FolderService(str(tmp_path))
    for _ in range(2):
        publish_documents(_docs(spark), service, "a", per_object=100)
    assert _read(spark, service, "a") == Counter(range(1_000))
    assert (tmp_path / "a" / RELEASED).read_text() == "1000"
    assert len(list((tmp_path / "a").glob("*.jsonl"))) == 11


def test_empty_run_is_released(spark, tmp_path):
    service = FolderService(str(tmp_path))
    publish_documents(_docs(spark, 0), service, "none")
    assert (tmp_path / "none" / RELEASED).read_text() == "0"


def test_failed_run_is_withdrawn(spark, tmp_path):
    service = failing(tmp_path, True)
    with pytest.raises(Exception, match="connection lost"):
        publish_documents(_docs(spark), service, "b", per_object=100)
    assert not (tmp_path / "b").exists()
    with pytest.raises(FileNotFoundError):
        service.read(spark, "b")


def test_retried_object_is_replaced(spark, tmp_path):
    """A task that died after half an object leaves no doubles when its object is put again."""
    service = failing(tmp_path, False)
    with pytest.raises(Exception, match="connection lost"):
        publish_documents(_docs(spark), service, "c", per_object=100)  # local masters retry no task
    FolderService.put(service, "c", "bucket-00000001", iter(['{"id": 1}'] * 3))
    publish_documents(_docs(spark), service, "c", per_object=100)
    assert _read(spark, service, "c") == Counter(range(1_000))


def test_rows_without_id_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "{}"), (None, "{}")], "id bigint, doc string")
    with pytest.raises(ValueError, match="1 rows"):
        publish_documents(df, FolderService(str(tmp_path)), "d")


def test_routing_reads_the_log_once(spark, tmp_path):
    log = spark.createDataFrame(
        [("kill", 1, "x"), ("PAUSE_A", 2, "y"), (None, 3, "z"), ("swap", 4, "v"), ("odd", 5, "w")],
        "type string, a int, b string",
    )
    seen = Observation()
    path = str(tmp_path / "routes")
    counted = log.observe(seen, F.count(F.lit(1)).alias("n"))
    sinks.route_typed(counted, "type", path, {"kill": ["a"], "swap": ["b"], "PAUSE_A": ["a"]})
    assert seen.get["n"] == 5
    read = lambda *args: [tuple(r) for r in sinks.read_typed(spark, path, *args).orderBy("b").collect()]
    stored = spark.read.parquet(path)
    assert stored.filter("route = 'kill'").select("type", "a", "b").collect() == [(None, 1, None)]
    assert read("swap", ["b"]) == [("v",)]
    assert read(sinks.PAUSES) == [("PAUSE_A", 2, "y")]
    assert read(sinks.OTHER) == [("odd", 5, "w"), (None, 3, "z")]
