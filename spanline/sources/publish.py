"""Publishing documents by id, all of a run or none of it.

A service takes documents in objects of one run and shows a run once it is released
(an HTTP API with drafts, a bucket, a folder).  Spark's data source writer gives the two
steps: tasks put objects, the driver releases the run after the last task, or withdraws it
when the job fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

RELEASED = "_released"


class Service(Protocol):
    """What a target of documents offers; every call may come twice."""

    def put(self, run: str, name: str, docs: Iterator[str]) -> int:
        """Store an object of a run in place of one of that name; the number of its documents."""

    def release(self, run: str, n: int) -> None:
        """Show the run, which has ``n`` documents."""

    def withdraw(self, run: str) -> None:
        """Delete what was put for a run that was not released."""


@dataclass(frozen=True)
class FolderService:
    """Documents as lines of files under ``root/run``; a marker file shows the run.

    ``root`` is a folder that driver and executors share, or the address of a file system
    known to pyarrow.
    """

    root: str

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", self.root))

    def put(self, run: str, name: str, docs: Iterator[str]) -> int:
        fs, path = self._open()
        fs.create_dir(f"{path}/{run}", recursive=True)
        n = 0
        with fs.open_output_stream(f"{path}/{run}/{name}.jsonl") as out:
            for doc in docs:
                out.write(doc.encode() + b"\n")
                n += 1
        return n

    def release(self, run: str, n: int) -> None:
        fs, path = self._open()
        fs.create_dir(f"{path}/{run}", recursive=True)
        with fs.open_output_stream(f"{path}/{run}/{RELEASED}") as out:
            out.write(str(n).encode())

    def withdraw(self, run: str) -> None:
        fs, path = self._open()
        if fs.get_file_info(f"{path}/{run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/{run}")

    def read(self, spark: SparkSession, run: str) -> DataFrame:
        """The documents of a released run, one JSON string a row in ``doc``."""
        fs, path = self._open()
        if fs.get_file_info(f"{path}/{run}/{RELEASED}").type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"run {run} is not released")
        files = spark.read.option("pathGlobFilter", "*.jsonl").schema("value string")
        return files.text(f"{self.root}/{run}").withColumnRenamed("value", "doc")


@dataclass
class _Put(WriterCommitMessage):
    documents: int


class _Writer(DataSourceWriter):
    def __init__(self, service: Service, run: str):
        self.service, self.run = service, run

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """Rows come sorted by bucket, so an object is streamed and closed before the next."""
        rows, n = iter(iterator), 0
        row = next(rows, None)
        while row is not None:
            bucket = row["bucket"]

            def docs() -> Iterator[str]:
                nonlocal row
                while row is not None and row["bucket"] == bucket:
                    yield row["doc"]
                    row = next(rows, None)

            n += self.service.put(self.run, f"bucket-{bucket:08d}", docs())
        return _Put(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.service.release(self.run, sum(m.documents for m in messages if m is not None))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.service.withdraw(self.run)


def _source(service: Service) -> type[DataSource]:
    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return "spanline_documents"

        def writer(self, schema, overwrite):
            return _Writer(service, self.options["run"])

    return Documents


def publish_documents(
    df: DataFrame,
    service: Service,
    run: str,
    id: str = "id",
    doc: str = "doc",
    per_object: int = 50_000,
) -> None:
    """Publish one document per id, in objects of about ``per_object``, as ``run``.

    An id's object follows from the id and the number of rows alone, and its documents
    are sorted, so a retried, doubled or repeated task puts the same object again, and so
    does a run published twice.  Of the documents of one id the least is published; a row
    without id or document fails the run before anything is put.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("_id"), F.col(doc).cast("string").alias("doc"))
    n, bad = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("_id").isNull() | F.col("doc").isNull())
    ).first()
    if bad:
        raise ValueError(f"{bad} rows without id or document")
    objects = max(1, -(-n // per_object))
    spark.dataSource.register(_source(service))
    (
        rows.groupBy("_id")
        .agg(F.min("doc").alias("doc"))
        .withColumn("bucket", F.pmod(F.xxhash64("_id"), F.lit(objects)).cast("int"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "_id")
        .select("bucket", "doc")
        .write.format("spanline_documents")
        .option("run", run)
        .mode("append")
        .save()
    )
