"""Sources and sinks (SRC-*, SNK-*), written and read back over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import (
    FRAMES,
    IV,
    SESSIONS,
    frames,
    iv,
    sessions,
    table,
)
from spanline.ordered import deal, tasks_for
from spanline.session import scratch_path
from spanline.sources import readers as rd
from spanline.sources import sinks as sk
from spanline.sources.publish import FolderService, publish_documents
from spanline.timeunits import micros


@query("src01_read_vocab_json", "select distinct lower(s_name) as value from supplier union select lower(n_name) from nation")
def read_vocab_json(spark, sf):
    path = scratch_path(spark, "vocab")
    names = table(spark, sf, "supplier").select(F.col("s_name").alias("name")).unionByName(
        table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    )
    names.write.json(path)
    return rd.read_vocab_json(spark, path, "name")


@query(
    "src02_read_rounds",
    """select o_orderkey as id, o_custkey as vod_id, o_orderpriority as mode, 2::int as n_sequences,
  round(o_totalprice / 1000, 3) as second_end from orders where o_orderpriority = '2-HIGH'""",
)
def read_rounds(spark, sf):
    path = scratch_path(spark, "rounds")
    end = F.col("o_totalprice") / 1000
    half = F.struct(F.lit(0.0).alias("beg"), (end / 2).alias("end"))
    rest = F.struct((end / 2).alias("beg"), end.alias("end"))
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("vod_id"),
        F.lit(0.0).alias("begin"), end.alias("end"), F.lit("L").alias("attacking_side"),
        F.col("o_orderpriority").alias("spectator_mode"),
        F.col("o_orderstatus").alias("annotation_status"), F.array(half, rest).alias("sequences"),
    ).write.json(path)
    return rd.read_rounds(spark, path, "2-HIGH").select(
        "id", "vod_id", F.col("spectator_mode").alias("mode"), F.size("sequences").alias("n_sequences"),
        F.round(F.col("sequences")[1]["end"], 3).alias("second_end"),
    )


@query(
    "src02_read_vods",
    "select c_custkey as id, c_name as title, c_mktsegment as channel from customer",
)
def read_vods(spark, sf):
    path = scratch_path(spark, "vods")
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("M").alias("type"),
        F.struct(F.col("c_mktsegment").alias("name")).alias("channel"),
    ).write.json(path)
    return rd.read_vods(spark, path).select("id", "title", F.col("channel.name").alias("channel"))


@query(
    "src03_explode_states",
    f"""with {IV} select grp, case when grp % 2 = 0 then 'left' else 'right' end as side, (grp % 6)::varchar as slot,
  'hero' as attr, (row_number() over (partition by grp order by b, e) - 1)::int as pos, b, e, status from iv""",
)
def explode_states(spark, sf):
    """Intervals packed into nested documents, written as JSON, read and exploded again."""
    path = scratch_path(spark, "states")
    states = iv(spark, sf).select(
        "grp", F.when(F.col("grp") % 2 == 0, "left").otherwise("right").alias("side"),
        (F.col("grp") % 6).cast("string").alias("slot"), F.lit("hero").alias("attr"), "b", "e", "status",
    )
    rd.pack_states(states, ["grp"]).write.json(path)
    docs = spark.read.schema(f"grp BIGINT, states {rd.STATES_TYPE}").json(path)
    return rd.explode_states(docs, "states", ["grp"])


@query(
    "src04_read_feed_items",
    """select conv_id, turn, role, lower(text) as text, array_to_string(list_transform(string_split(text, ' ')[1:3], lambda x: lower(x)), ' ') as head
from conversations""",
)
def read_feed_items(spark, sf):
    path = scratch_path(spark, "feed")
    table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text", F.slice(F.split("text", " "), 1, 3).alias("head")
    ).write.json(path)
    items = rd.read_feed_items(
        spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, head ARRAY<STRING>"
    )
    return items.withColumn("head", F.array_join("head", " "))


@query(
    "src05_read_csv_table",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority, year(o_orderdate)::int as y from orders""",
)
def read_csv_table(spark, sf):
    path = scratch_path(spark, "csv")
    out = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority"
    )
    sk.write_csv(out, path, ["o_orderkey", "o_orderdate", "o_orderpriority"])
    back = rd.read_csv_table(spark, path, "o_orderkey BIGINT, o_orderdate DATE, o_orderpriority STRING")
    return back.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority",
        F.year("o_orderdate").alias("y"),
    )


@query(
    "src06_read_label_set",
    """select (row_number() over (order by l) - 1)::int as label_id, l as label from (select distinct event_type as l from events)""",
)
def read_label_set(spark, sf):
    path = scratch_path(spark, "labels")
    vocab = table(spark, sf, "events").select("event_type").distinct()
    # a vocabulary is a small ordered file: one row, one text
    vocab.agg(
        F.array_join(F.sort_array(F.collect_set("event_type")), "\n").alias("value")
    ).coalesce(1).write.option("lineSep", "\n").text(path)
    return rd.read_label_set(spark, f"{path}/part-*")


def _samples(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("mode"),
        F.when(F.pmod(F.col("doc_id"), F.lit(5)) < 4, "train").otherwise("val").alias("split"),
        "source", "n_chars",
    )


@query(
    "src07_snk01_samples",
    """select mode, split, count(*) as n, sum(n_chars)::bigint as chars, count(*) // 25 as batches from (
  select lang as mode, case when doc_id % 5 < 4 then 'train' else 'val' end as split, n_chars from documents)
where mode in ('en', 'fr') and split = 'train' group by 1, 2""",
)
def samples_round_trip(spark, sf):
    path = scratch_path(spark, "samples")
    sk.write_samples(_samples(spark, sf), path)
    back = rd.read_samples(spark, path, ["en", "fr"], "train")
    return back.groupBy("mode", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    ).withColumn("batches", F.floor(F.col("n") / 25))


@query("src07_batch_count", "select count(*) as n, count(*) // 100 as batches from documents")
def batch_count(spark, sf):
    return rd.batch_count(table(spark, sf, "documents"), 100)


@query(
    "src08_default_columns",
    """select d.doc_id, coalesce(case when toxic = 1 then 'toxic' end, 'not_toxic') as toxic, 'not_zoom' as zoom
from documents d left join labels using (doc_id)""",
)
def default_columns(spark, sf):
    """Two writes with different columns; the missing label column is defaulted."""
    path = scratch_path(spark, "defaults")
    lab = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("toxic"))
    s = _samples(spark, sf)
    sk.write_samples(s.join(lab, "doc_id"), path)
    sk.write_samples(s.join(lab, "doc_id", "left_anti"), path)
    back = rd.read_samples(spark, path, defaults={"toxic": "not_toxic", "zoom": "not_zoom"})
    return back.select("doc_id", "toxic", "zoom")


def _stats_docs(spark, sf):
    """Order -> game (return flag) -> team (status) -> player (part) with nested stats.

    Each level is grouped before the next; an order has a handful of lines.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity", "l_tax"
    )
    # one exchange on the document key serves all four levels; tasks of a bounded number of
    # lines group them without spilling
    tasks = tasks_for(spark, lines.count())
    dealt = deal(lines, ["l_orderkey"], tasks) if tasks else lines.repartition("l_orderkey")
    li = dealt.groupBy("l_orderkey", "l_returnflag", "l_linestatus", "l_partkey").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_tax").alias("tax")
    )
    stats = F.create_map(F.lit("qty"), F.col("qty"), F.lit("tax"), F.col("tax"))
    hero = F.create_map(
        F.concat(F.lit("h"), (F.col("l_partkey") % 5).cast("string")),
        F.create_map(F.lit("qty"), F.col("qty")),
    )
    player = F.struct(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), stats.alias("stats"),
        hero.alias("hero_stats"),
    )
    teams = li.withColumn("p", player).groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(
        F.collect_list("p").alias("players")
    )
    team = F.struct(F.col("l_linestatus").alias("name"), "players")
    games = teams.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(team).alias("teams"))
    game = F.struct(
        F.col("l_returnflag").alias("map"), F.col("l_orderkey").alias("match_id"),
        F.ascii("l_returnflag").alias("game_number"), "teams",
    )
    return games.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(game).alias("games"))


@query(
    "src09_ml07_flatten_stats",
    """with p as (select l_orderkey, l_returnflag, l_linestatus, l_partkey, sum(l_quantity) as qty, max(l_tax) as tax
   from lineitem group by 1, 2, 3, 4),
r as (select l_orderkey as match, ascii(l_returnflag)::int as game, l_linestatus as team, 'p' || l_partkey::varchar as player,
   null::varchar as hero, 'qty' as stat, qty as value from p
 union all select l_orderkey, ascii(l_returnflag)::int, l_linestatus, 'p' || l_partkey::varchar, null, 'tax', tax from p
 union all select l_orderkey, ascii(l_returnflag)::int, l_linestatus, 'p' || l_partkey::varchar, 'h' || (l_partkey % 5)::varchar, 'qty', qty from p)
select match, game, team, player, hero, stat, round(value, 4) as value from r""",
)
def flatten_stats(spark, sf):
    path = scratch_path(spark, "stats")
    sk.write_docs(_stats_docs(spark, sf), path, "gzip")
    docs = spark.read.schema(rd.STATS_SCHEMA).json(path)
    return rd.flatten_stats(docs).withColumn("value", F.round("value", 4))


@query("src10_read_pages", "select page_id, url, length(html)::int as n from pages")
def read_pages(spark, sf):
    return rd.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n"))


@query(
    "snk02_write_dual",
    """select doc_id, true as has, 1::int as kind from documents join labels using (doc_id)
union all select doc_id, doc_id in (select doc_id from labels), 0 from documents""",
)
def write_dual(spark, sf):
    """Both tables read back; ``kind`` 0 is the full one."""
    full, seq = scratch_path(spark, "exists"), scratch_path(spark, "sequence")
    lab = table(spark, sf, "labels").select("doc_id", F.lit(2).alias("length"))
    rows = table(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left").select(
        "doc_id", F.coalesce("length", F.lit(1)).alias("length"), F.col("length").isNotNull().alias("has")
    )
    sk.write_dual(rows, full, seq, "length", ["has"])
    a = spark.read.parquet(full).select("doc_id", "has", F.lit(0).alias("kind"))
    b = spark.read.parquet(seq).select("doc_id", F.lit(True).alias("has"), F.lit(1).alias("kind"))
    return a.unionByName(b)


@query("snk03_write_csv", "select o_orderpriority, o_orderkey, o_orderstatus from orders")
def write_csv(spark, sf):
    path = scratch_path(spark, "subset")
    header = ["o_orderpriority", "o_orderkey", "o_orderstatus"]
    sk.write_csv(table(spark, sf, "orders"), path, header)
    return rd.read_csv_table(spark, path, "o_orderpriority STRING, o_orderkey BIGINT, o_orderstatus STRING")


@query(
    "snk04_write_docs",
    """select o_orderkey, o_orderstatus as status, o_custkey as cust, (o_orderpriority like '1%') as urgent from orders""",
)
def write_docs(spark, sf):
    path = scratch_path(spark, "docs")
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.struct(
            F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"),
            F.struct(F.col("o_orderpriority").startswith("1").alias("urgent")).alias("more"),
        ).alias("d"),
    )
    sk.write_docs(o, path)
    back = spark.read.schema(
        "o_orderkey BIGINT, d STRUCT<status: STRING, cust: BIGINT, more: STRUCT<urgent: BOOLEAN>>"
    ).json(path)
    return back.select(
        "o_orderkey", "d.status", "d.cust", F.col("d.more.urgent").alias("urgent")
    )


@query(
    "snk05_documents",
    """select o_orderkey, json_extract_string(d, '$.o_orderstatus') as status from (select o_orderkey,
  to_json({'o_orderstatus': o_orderstatus}) as d from orders)""",
)
def documents_to_publish(spark, sf):
    docs = sk.to_documents(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), ["o_orderkey"]
    )
    return docs.select("o_orderkey", F.get_json_object("doc", "$.o_orderstatus").alias("status"))


@query(
    "snk06_route_events",
    """select event_type as type, count(*) as n, round(sum(value), 2) as total from events group by 1""",
)
def route_events(spark, sf):
    path = scratch_path(spark, "routes")
    log = table(spark, sf, "events").select(F.col("event_type").alias("type"), "event_id", "value")
    sk.route_by_type(log, "type", path)
    return spark.read.parquet(path).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "snk06_route_with_pauses",
    """select case event_type when 'error' then 'pauses' when 'click' then 'click' when 'view' then 'view'
  else 'other' end as source, count(*) as n from events group by 1""",
)
def route_with_pauses(spark, sf):
    path, pauses = scratch_path(spark, "typed"), scratch_path(spark, "pauses")
    log = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "PAUSE_START").otherwise(F.col("event_type")).alias("type"),
        "event_id", "user_id", "value",
    )
    sk.route_events(
        log, "type", path, {"click": ["event_id", "user_id"], "view": ["event_id", "value"]}, pauses
    )
    parts = {"click": f"{path}/click", "view": f"{path}/view", "other": f"{path}/{sk.OTHER}", "pauses": pauses}
    out = None
    for name, p in parts.items():
        one = spark.read.parquet(p).agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk05_publish", "select doc_id, lang, md5(text) as text_md5 from documents")
def publish_and_read(spark, sf):
    """Every document published by id with its whole text, and the released run read back."""
    service = FolderService(scratch_path(spark, "published"))
    docs = sk.to_documents(table(spark, sf, "documents").select("doc_id", "lang", "text"), ["doc_id"])
    publish_documents(docs, service, "documents", "doc_id")
    back = F.from_json("doc", "doc_id BIGINT, lang STRING, text STRING").alias("d")
    return service.read(spark, "documents").select(back).select(
        "d.doc_id", "d.lang", F.md5("d.text").alias("text_md5")
    )


@query(
    "snk06_route_typed",
    """select case event_type when 'error' then 'pauses' when 'click' then 'click' when 'view' then 'view'
  else 'other' end as source, event_id, case when event_type <> 'view' then user_id end as user_id,
  case when event_type <> 'click' then value end as value from events""",
)
def route_typed(spark, sf):
    """One pass into typed tables, every row of each read back."""
    path = scratch_path(spark, "one-pass")
    kind = F.col("event_type")
    log = table(spark, sf, "events").select(
        F.when(kind == "error", "PAUSE_START").otherwise(kind).alias("type"), "event_id", "user_id", "value"
    )
    columns = {"click": ["event_id", "user_id"], "view": ["event_id", "value"]}
    sk.route_typed(log, "type", path, columns)
    rest = ["event_id", "user_id", "value"]
    parts = [("click", "click", columns["click"]), ("view", "view", columns["view"]),
             ("other", sk.OTHER, rest), ("pauses", sk.PAUSES, rest)]
    out = None
    for name, route, cols in parts:
        one = sk.read_typed(spark, path, route, cols).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query("snk07_purge_ids", "select doc_id, lang as mode from documents where doc_id not in (select doc_id from labels where quality = 0)")
def purge_ids(spark, sf):
    path, target = scratch_path(spark, "before"), scratch_path(spark, "after")
    sk.write_samples(_samples(spark, sf), path)
    ids = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    sk.purge_ids(spark, path, ids, "doc_id", target)
    return spark.read.parquet(target).select("doc_id", "mode")


@query(
    "snk08_backfill",
    """select d.doc_id, case when d.doc_id % 2 = 0 then d.source when quality is not null then 'q' || quality::varchar end as source
from documents d left join labels using (doc_id)""",
)
def backfill(spark, sf):
    path, target = scratch_path(spark, "gaps"), scratch_path(spark, "filled")
    s = _samples(spark, sf).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    sk.write_samples(s, path)
    attrs = table(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source")
    )
    sk.backfill(spark, path, attrs, "doc_id", "source", target)
    return spark.read.parquet(target).select("doc_id", "source")


@query(
    "snk09_manifest",
    """select o_orderkey as id, o_custkey as match, (o_orderkey % 7)::bigint as game_number, (o_orderkey % 3)::bigint as round_number from orders""",
)
def manifest(spark, sf):
    o = table(spark, sf, "orders").withColumns(
        {"g": F.col("o_orderkey") % 7, "r": F.col("o_orderkey") % 3}
    )
    return sk.manifest(o, "o_orderkey", "o_custkey", "g", "r")


@query(
    "snk10_wide_timeline",
    f"""with {FRAMES} select grp, t, max(case when k % 3 = 0 then label end) as player0,
  max(case when k % 3 = 1 then label end) as player1, max(case when k % 3 = 2 then label end) as player2
from (select grp, t // 86400000000 as t, k, label from frames) group by 1, 2""",
)
def wide_timeline(spark, sf):
    f = frames(spark, sf).select(
        "grp", F.floor(F.col("t") / 86_400_000_000).alias("t"), "label",
        F.concat(F.lit("player"), (F.col("k") % 3).cast("string")).alias("slot"),
    )
    return sk.wide_timeline(f, ["grp"], "t", "slot", "label", ["player0", "player1", "player2"])


@query(
    "snk10_game_meta",
    f"""with {FRAMES},{SESSIONS} select grp, len(list(b))::int as n, array_to_string(list(b order by b), ',') as begins,
  array_to_string(list(e order by b), ',') as ends from sessions group by 1""",
)
def game_meta(spark, sf):
    meta = sk.game_meta(sessions(spark, sf), ["grp"])
    return meta.select(
        "grp", F.size("begins").alias("n"),
        F.array_join(F.transform("begins", lambda x: x.cast("string")), ",").alias("begins"),
        F.array_join(F.transform("ends", lambda x: x.cast("string")), ",").alias("ends"),
    )


@query(
    "ml08_integrity_scan",
    """select count(*) filter (event_id % 50 = 0) as n_bad, count(*) as n from events""",
)
def integrity_scan(spark, sf):
    path = scratch_path(spark, "integrity")
    ok = F.to_json(F.struct("event_id", "event_type"))
    table(spark, sf, "events").select(
        F.when(F.col("event_id") % 50 == 0, F.substring(ok, 1, 9)).otherwise(ok).alias("value")
    ).write.text(path)
    per_file = rd.integrity_scan(spark, path, "event_id BIGINT, event_type STRING")
    return per_file.agg(F.sum("n_bad").alias("n_bad"), F.sum("n").alias("n"))


@query(
    "ml08_vocabulary_drift",
    """select distinct l_returnflag as label, 'removed' as change from lineitem where l_returnflag not in
 (select o_orderstatus from orders) union all select distinct o_orderstatus, 'added' from orders
where o_orderstatus not in (select l_returnflag from lineitem)""",
)
def vocabulary_drift(spark, sf):
    now = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"))
    stored = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"))
    return rd.vocabulary_drift(now, stored)


@query(
    "h08_event_days",
    "select event_id, epoch_us(ts) // 1000 as ms, strftime(ts, '%Y-%m-%d') as day from events",
)
def event_days(spark, sf):
    from spanline.functions.text import ms_to_date

    return table(spark, sf, "events").select(
        "event_id", F.floor(micros("ts") / 1000).alias("ms")
    ).withColumn("day", F.date_format(ms_to_date("ms"), "yyyy-MM-dd"))
