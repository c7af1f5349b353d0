"""The quality classifier where many rows have no words or one text."""

from __future__ import annotations

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_wordless_and_repeated_rows_do_not_move_the_classes(spark):
    from spanline.llm.quality import drawn, score

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n, hot = table.count(), table.join(labels.filter("quality = 1"), "doc_id").orderBy("doc_id").first().text
    none = spark.range(n).select((-1 - F.col("id")).alias("doc_id"), F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" \n")), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    one = spark.range(n).select((1_000_000 + F.col("id")).alias("doc_id"), F.lit(hot).alias("text"))
    same = spark.range(n).select(F.lit(5_000_000).cast("bigint").alias("doc_id"), F.lit(hot).alias("text"))
    rows = table.union(none).union(one).union(same)
    judged = score(rows, ["doc_id"]).select("doc.doc_id", "posterior", "kept").join(labels, "doc_id")
    right = {
        r["quality"]: r
        for r in judged.groupBy("quality").agg(
            F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")).alias("kept"),
            F.avg(((F.col("posterior") > 0.5) == (F.col("quality") == 1)).cast("double")).alias("posterior"),
        ).collect()
    }
    assert right[1]["kept"] > 0.95 and right[0]["kept"] > 0.85
    assert right[1]["posterior"] > 0.95 and right[0]["posterior"] > 0.85
    worded = table.filter("text rlike '\\\\S'").union(one).union(same)
    some = drawn(worded, 400)
    assert 300 < some.count() < 500 and some.filter("doc_id = 5000000").count() <= 1
    assert 0 < some.filter("doc_id between 1000000 and 4999999").count() < 300
