"""Session helpers: defaults for local runs and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_GROUP_ROWS = "spanline.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # no call-site capture per column expression: plans here have hundreds of them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def max_group_rows(spark: SparkSession) -> int:
    """Largest group one window task may hold before the split form is used."""
    return int(spark.conf.get(MAX_GROUP_ROWS, str(DEFAULT_MAX_GROUP_ROWS)))


def _one_machine(master: str) -> bool:
    """Threads of one JVM; ``local-cluster`` has executors with folders of their own."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  A
    temporary folder is used only on a local master that names none.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not _one_machine(sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="spanline-ckpt-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for files written and read back; shared where the cluster names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not _one_machine(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.gettempdir()
    return f"{base}/spanline-{name}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rules or lookup table written in code.

    Arrow input becomes a local relation whose size Spark knows, so joins with it
    can be broadcast; a plain list would become an RDD of unknown size.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    data = [dict(zip(arrow.names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=arrow))
