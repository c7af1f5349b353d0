"""From raw documents to sharded training text, one operator a stage.

Each stage works on all rows that the one before kept, written as Parquet and read again.
All but the last return the columns of ``documents``; the last returns places in shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanline.llm.common import Shared, table
from spanline.llm.decontaminate import decontaminate
from spanline.llm.language import keep_identified
from spanline.llm.mixing import mix_documents
from spanline.llm.near_dedup import one_of_each_group
from spanline.llm.sharding import assign_shards


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of random ones; names the language where it is null."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the smallest id."""
    return one_of_each_group(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a twentieth or more of their words from the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to twice."""
    return mix_documents(docs, limit=2.0, cover=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """40 shards of equal counts, copies of a text together."""
    out = assign_shards(docs, ["doc_id", "lang", "source", "n_chars"])
    return out.select("doc.*", *[c for c in out.columns if c != "doc"])


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", near_dedup),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language ID is a trained model, so SQL can't say the rows; tests/llm holds the stages against plain rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.keep(docs, str(k))
            if k:
                shared.drop(str(k - 1))
    return docs
