"""Reading vocabularies, rounds, documents, CSV tables, samples and pages.

Schemas are stated, never inferred from data; filters are plain predicates, so
Parquet and partition pruning apply.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND_SCHEMA = (
    "id BIGINT, vod_id BIGINT, begin DOUBLE, end DOUBLE, attacking_side STRING, "
    "spectator_mode STRING, annotation_status STRING, "
    "sequences ARRAY<STRUCT<beg: DOUBLE, end: DOUBLE>>, map STRING, "
    "left_color_hex STRING, right_color_hex STRING"
)
VOD_SCHEMA = (
    "id BIGINT, title STRING, url STRING, type STRING, "
    "channel STRUCT<name: STRING, site: STRING>, film_format STRUCT<code: STRING>, "
    "spectator_mode STRING"
)
STATES_TYPE = (
    "MAP<STRING, MAP<STRING, MAP<STRING, "
    "ARRAY<STRUCT<begin: DOUBLE, end: DOUBLE, status: STRING>>>>>"
)
STAT_ROW = "name: STRING, stats: MAP<STRING, DOUBLE>"
STATS_SCHEMA = (
    "id BIGINT, date STRING, team_one STRING, team_two STRING, "
    "games ARRAY<STRUCT<map: STRING, match_id: BIGINT, game_number: INT, "
    f"teams: ARRAY<STRUCT<name: STRING, players: ARRAY<STRUCT<{STAT_ROW}, "
    "hero_stats: MAP<STRING, MAP<STRING, DOUBLE>>>>>>>>"
)


def read_vocab_json(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Lower-cased, distinct, sorted names as ``value``."""
    rows = spark.read.schema(f"`{field}` STRING").json(path)
    return rows.select(F.lower(field).alias("value")).distinct().orderBy("value")


def read_rounds(
    spark: SparkSession, path: str, mode: str | None = None, id: int | None = None
) -> DataFrame:
    df = spark.read.schema(ROUND_SCHEMA).json(path)
    if mode is not None:
        df = df.filter(F.col("spectator_mode") == mode)
    return df if id is None else df.filter(F.col("id") == id)


def read_vods(spark: SparkSession, path: str, id: int | None = None) -> DataFrame:
    df = spark.read.schema(VOD_SCHEMA).json(path)
    return df if id is None else df.filter(F.col("id") == id)


def explode_states(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested side -> slot -> attribute -> intervals to one row per interval, with its position."""
    return (
        df.select(*keep, F.explode(col).alias("side", "_a"))
        .select(*keep, "side", F.explode("_a").alias("slot", "_b"))
        .select(*keep, "side", "slot", F.explode("_b").alias("attr", "_c"))
        .select(*keep, "side", "slot", "attr", F.posexplode("_c").alias("pos", "_i"))
        .select(
            *keep, "side", "slot", "attr", "pos",
            F.round(F.col("_i.begin") * 1e6).cast("bigint").alias("b"),
            F.round(F.col("_i.end") * 1e6).cast("bigint").alias("e"),
            F.col("_i.status").alias("status"),
        )
    )


def pack_states(
    iv: DataFrame, keys: Sequence[str], out: str = "states", part_rows: int = 100_000
) -> DataFrame:
    """The inverse: ``(keys, side, slot, attr, b, e, status)`` to one nested document per key.

    Timelines are cut after ``part_rows`` intervals each; equal ``part`` numbers (from 0)
    of a key's timelines meet in one document.  Together the documents hold every
    interval once and in order.
    """
    from spanline.operators.intervals import chunk_sequences

    timeline = [*keys, "side", "slot", "attr"]
    iv = chunk_sequences(iv, timeline, ["b", "e"], part_rows)
    item = F.struct((F.col("b") / 1e6).alias("begin"), (F.col("e") / 1e6).alias("end"), "status")
    doc = (
        iv.withColumn("part", F.col("chunk"))
        .groupBy("part", *timeline)
        .agg(F.array_sort(F.collect_list(item)).alias("l"))
    )
    for key, by in (("attr", ["side", "slot"]), ("slot", ["side"]), ("side", [])):
        entry = F.map_from_entries(F.collect_list(F.struct(key, "l")))
        doc = doc.groupBy("part", *keys, *by).agg(entry.alias("l"))
    return doc.withColumnRenamed("l", out)


def lower_strings(df: DataFrame) -> DataFrame:
    """Every string and every element of a string array in lower case."""
    out: dict[str, Column] = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "string":
            out[f.name] = F.lower(f.name)
        elif kind == "array<string>":
            out[f.name] = F.transform(f.name, lambda x: F.lower(x))
    return df.withColumns(out) if out else df


def read_feed_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return lower_strings(spark.read.schema(schema).json(path))


def read_csv_table(
    spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, dateFormat=date_format)


def read_label_set(spark: SparkSession, path: str) -> DataFrame:
    """Ordered vocabulary file: line number (from 0) is the label id."""
    lines = spark.read.text(path, wholetext=True)
    # a final line break ends the last line, it does not open another one
    body = F.regexp_replace("value", r"\r?\n$", "")
    return lines.select(
        F.posexplode(F.split(body, r"\r?\n")).alias("label_id", "label")
    ).withColumn("label", F.trim("label"))


def read_samples(
    spark: SparkSession,
    path: str,
    modes: Sequence[str] | None = None,
    split: str | None = None,
    defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """Stored samples, pruned by mode and split; missing label columns become ``not_<attr>``."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if modes is not None:
        df = df.filter(F.col("mode").isin(*modes))
    if split is not None:
        df = df.filter(F.col("split") == split)
    for col, value in (defaults or {}).items():
        have = F.col(col) if col in df.columns else F.lit(None).cast("string")
        df = df.withColumn(col, F.coalesce(have, F.lit(value)))
    return df


def batch_count(df: DataFrame, batch: int) -> DataFrame:
    """Rows and whole batches of a sample table."""
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("batches", F.floor(F.col("n") / batch))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).option("multiLine", "true").json(path)


def flatten_stats(df: DataFrame) -> DataFrame:
    """Nested stats to ``(match, game, team, player, hero, stat, value)``; hero NULL is the total."""
    players = (
        df.select(F.col("id").alias("match"), F.explode("games").alias("g"))
        .select("match", F.col("g.game_number").alias("game"), F.explode("g.teams").alias("t"))
        .select("match", "game", F.col("t.name").alias("team"), F.explode("t.players").alias("p"))
        .select("match", "game", "team", F.col("p.name").alias("player"), "p.stats", "p.hero_stats")
    )
    own = F.map_entries(
        F.map_from_arrays(F.array(F.lit("")), F.array(F.col("stats")))
    )
    both = F.concat(own, F.coalesce(F.map_entries("hero_stats"), F.array().cast(
        "array<struct<key:string,value:map<string,double>>>")))
    return (
        players.select("match", "game", "team", "player", F.explode(both).alias("h"))
        .select(
            "match", "game", "team", "player",
            F.nullif(F.col("h.key"), F.lit("")).alias("hero"),
            F.explode("h.value").alias("stat", "value"),
        )
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages ``(page_id, url, html)``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def integrity_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON sample rows per file and how many do not fit the schema or lack its first column."""
    df = (
        spark.read.schema(f"{schema}, _corrupt_record STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    bad = F.col("_corrupt_record").isNotNull() | F.col(df.columns[0]).isNull()
    return (
        df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("bigint")).alias("n_bad"))
    )


def vocabulary_drift(now: DataFrame, stored: DataFrame, label: str = "label") -> DataFrame:
    """Labels only in one of two vocabularies."""
    a, b = now.select(label).distinct(), stored.select(label).distinct()
    return (
        a.subtract(b).withColumn("change", F.lit("added"))
        .unionByName(b.subtract(a).withColumn("change", F.lit("removed")))
    )
