"""Texts that the language stage has to keep."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string"


def test_stage_keeps_mixed_texts_and_unlabelled_scripts(spark):
    from spanline.llm.language import keep_identified

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    long = table.filter("n_chars > 1500" if "n_chars" in table.columns else "length(text) > 1500").filter("lang is not null")
    parts = [r["text"][:600] for r in long.groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).orderBy("lang").collect()]
    assert len(parts) >= 3
    odd = [(-1, "\n".join(parts[:3]), None), (-2, "Слово за слово " * 40, None), (-3, "12 34 ... !", None), (-4, None, None), (-5, parts[0], None)]
    rows = table.union(spark.createDataFrame(odd, SCHEMA))
    assert {r["doc_id"] for r in keep_identified(rows).filter("doc_id < 0").collect()} == {-1, -2, -5}
    unlabelled = rows.withColumn("lang", F.lit(None).cast("string"))
    assert keep_identified(unlabelled).count() == rows.count()
