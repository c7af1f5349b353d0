"""Registered queries of this package: name to callable, and SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op10_minhash_near_dedup",
    rf"""
with recursive w as (
  select doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') ws from documents
), s as (
  select distinct doc_id, unnest(case
    when len(ws) >= 5
    then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g
  from w
), n as (
  select doc_id, count(*) n from s group by doc_id
), common as (
  select a.doc_id a, b.doc_id b, count(*) i
  from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), link as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * i >= 75 * (x.n + y.n - i)
), reach as (
  select doc_id, doc_id r from documents
  union
  select reach.doc_id, b from reach join link on reach.r = a
), c as (
  select doc_id, min(r) component_id from reach group by doc_id
)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, d.doc_id = component_id kept
from documents d join c using (doc_id) left join n using (doc_id)
""",
)
def op10(spark, sf_dir):
    from spanline.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op7_benchmark_decontamination",
    rf"""
with dw as (
  select doc_id, coalesce(regexp_extract_all({LOWER_SQL},
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) ws from documents
), bw as (
  select item_id, regexp_extract_all({LOWER_SQL},
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark
), sized as (
  select item_id, ws, least(13, len(ws)) k from bw where len(ws) > 0
), win as (
  select distinct item_id, k, unnest(
    list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) g
  from sized
), spots as (
  select doc_id, k, unnest(range(1, len(ws) - k + 2)) p,
    unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) g
  from dw, (select distinct k from sized) where len(ws) >= k
), hit as (
  select doc_id, item_id, p, spots.k from spots join win on spots.k = win.k and spots.g = win.g
), places as (
  select doc_id, count(distinct w) n_hit from (
    select doc_id, unnest(range(p, p + k)) w from hit) group by doc_id
), items as (
  select doc_id, count(distinct item_id) n_items,
    array_to_string(list_sort(list(distinct item_id::varchar)), ',') ids
  from hit group by doc_id
)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
  coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(ws), false) contaminated
from dw left join places using (doc_id) left join items using (doc_id)
""",
)
def op7(spark, sf_dir):
    from spanline.llm.decontaminate import find_matches, judged

    found = judged(
        find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    )
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op4_line_dedup",
    rf"""
with line as (
  select doc_id, unnest(range(len(ls))) pos, unnest(ls) line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents)
), keyed as (
  select doc_id, pos, line, {LOWER_SQL.replace("text", "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} k
  from line
), first as (
  select k, min(doc_id) f from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1
), judged as (
  select doc_id, pos, line, coalesce(doc_id > f, false) dropped from keyed left join first using (k)
)
select doc_id, count(*) n_lines, count(*) filter (dropped) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) kept_sha256
from judged group by doc_id
""",
)
def op4(spark, sf_dir):
    from spanline.llm.line_dedup import keep_bitmaps, with_kept_text

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_kept_text(docs, keep_bitmaps(docs)).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op9_sharding")
def op9(spark, sf_dir):
    from spanline.llm.sharding import assign_shards

    out = assign_shards(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc.doc_id", *[c for c in out.columns if c != "doc"])


def _mixing_sql() -> str:
    """The bisection as a chain of tables: e for the entropy, f for the repetition."""
    one = 64**5
    parts = ["e0 as (select 0 lo), f0 as (select 0 lo)"]
    for k in range(1, 6):
        size = 64 ** (5 - k)
        for name in "ef":
            parts.append(f"""{name}g{k} as (
  select g, (ln(sum(r)) - sum(r * ln(r)) / sum(r)) / ln(count(*)) ent, any_value(total) * max(r / t) / sum(r) rep
  from (select lo + i * {size} g, t, total, pow(t / total, (lo + i * {size}) / {one}.0::double) r
    from src, tot, {name}{k - 1}, (select unnest(range(65)) i))
  where g <= {one} group by g)""")
        parts.append(f"e{k} as (select max(g) lo from eg{k} where ent >= 0.97)")
        back = f"min(g) - {size}" if size > 1 else "min(g)"
        parts.append(f"""f{k} as (
  select case when min(g) = any_value(lo) then any_value(lo) else {back} end lo
  from fg{k}, f{k - 1} where rep <= 4)""")
    return rf"""
with w as (
  select doc_id, source, text, 1 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) n
  from documents group by all
), src as (
  select source, sum(n)::double t from w group by source
), tot as (
  select sum(t) total from src
), {", ".join(parts)}, raised as (
  select source, t, total, pow(t / total, greatest(e5.lo, f5.lo) / {one}.0::double) r from src, tot, e5, f5
), plan as (
  select source, t, round(r / (sum(r) over ()) * total)::bigint part, r / (sum(r) over ()) * 65536 quota from raised
), drawn as (
  select doc_id, source, n, part, quota, t, unnest(range(greatest(ceil(part / t)::bigint, 1))) epoch
  from w join plan using (source)
), placed as (
  select *, md5('0|' || epoch || '|' || doc_id) k from drawn
), ahead as (
  select *, sum(n) over (partition by source, epoch order by k) - n + epoch * t pos from placed
)
select doc_id, source, n n_tokens, epoch, floor(pos / quota)::bigint as block,
  row_number() over (partition by floor(pos / quota) order by k, source) - 1 slot
from ahead where pos < part
"""


@query("op5_source_mixing", _mixing_sql())
def op5(spark, sf_dir):
    from spanline.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op8_language_id")
def op8(spark, sf_dir):
    from spanline.llm.language import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    out = F.col("doc_id")
    model = train(docs.filter(~held_out(out)))
    return identify(docs, model, ["doc_id"]).select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query(
    "op3_exact_top_k",
    """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 10
""",
)
def op3(spark, sf_dir):
    from spanline.llm.topk import top_k, whole_vectors

    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024.0)
    return top_k(vectors.filter("id % 100 = 0"), vectors, 10)


URL_HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '\.$', '')"


@query(
    "op1_url_filter",
    rf"""
with p as (
  select page_id, url, {URL_HOST_SQL} host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) path,
    date '2024-01-01' + (page_id * 7919 % 365)::int fetched
  from pages
), names as (
  select distinct unnest([host, host || '/' || path]) k from p where host <> '' and path <> ''
), drawn as (
  select k, ('0x' || substr(md5(k), 1, 7))::bigint a, ('0x' || substr(md5(k), 8, 7))::bigint b from names
), entry as (
  select k, date '2024-01-01' + (a // 8 % 240)::int as day, 'add' as action from drawn where a % 8 < 3
  union all
  select k, date '2024-01-01' + (a // 8 % 240 + 10 + b % 90)::int, 'remove' from drawn where a % 8 < 2
  union all
  select k, date '2024-01-01' + (a // 8 % 240 + 60 + b % 150)::int, 'add' from drawn where a % 8 < 1
), decided as (
  select k, day, max(action) as action from entry group by k, day
), span as (
  select k, day b, coalesce(lead(day) over (partition by k order by day), date '9999-12-31') e, action from decided
), keys as (
  select distinct page_id, url, fetched, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
      lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    case when path <> '' then [host || '/' || path] else [] end)) k
  from p where host <> ''
), hit as (
  select page_id, url, fetched, max(struct_pack(n := length(k), k := k, b := b)) best
  from keys join span using (k) where action = 'add' and b <= fetched and fetched < e
  group by all
)
select p.page_id, p.url, p.fetched, best is not null blocked, best.k as rule, best.b as since
from p left join hit using (page_id, url, fetched)
""",
)
def op1(spark, sf_dir):
    """Pages carry no fetch date and there is no list, so both are derived from the pages."""
    from spanline.llm.url_filter import host, judge, path_start

    url = F.col("url")
    start = F.lit("2024-01-01").cast("date")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(start, F.expr("cast(page_id * 7919 % 365 as int)")).alias("fetched")
    )
    names = (
        pages.select(host(url).alias("h"), path_start(url).alias("p"))
        .filter("h is not null and p <> ''")
        .select(F.explode(F.array("h", F.concat_ws("/", "h", "p"))).alias("key"))
        .distinct()
    )
    part = lambda at: F.conv(F.substring(F.md5("key"), at, 7), 16, 10).cast("bigint")
    drawn = names.select("key", part(1).alias("a"), part(8).alias("b"))
    day = lambda days: F.date_add(start, F.expr(f"cast({days} as int)"))
    plan = [
        (3, "a div 8 % 240", "add"),
        (2, "a div 8 % 240 + 10 + b % 90", "remove"),
        (1, "a div 8 % 240 + 60 + b % 150", "add"),
    ]
    events = [
        F.when(F.col("a") % 8 < below, F.struct(day(days).alias("day"), F.lit(action).alias("action")))
        for below, days, action in plan
    ]
    entries = drawn.select("key", F.explode(F.array_compact(F.array(*events))).alias("e")).select("key", "e.day", "e.action")
    return judge(pages, entries).select("capture.*", "blocked", "rule", "since")


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    from spanline.llm.substring_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    from spanline.llm.quality import score

    return score(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc.doc_id", "posterior", "score", "kept")


@query(
    "op13_fill_in_middle",
    r"""
with w as (
  select doc_id, coalesce(text, '') t,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') ws,
    sha256('42:' || doc_id) d
  from documents
), h as (
  select doc_id, t, ws, len(ws) n, ('0x' || substr(d, 1, 8))::bigint h1, ('0x' || substr(d, 9, 8))::bigint h2,
    ('0x' || substr(d, 17, 8))::bigint h3, ('0x' || substr(d, 25, 8))::bigint h4
  from w
), f as (
  select doc_id, t, ws, n, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end form
  from h
), cut as (
  select doc_id, t, n, form, array_to_string(ws[1:a], '') p, array_to_string(ws[a + 1:b], '') m,
    array_to_string(ws[b + 1:], '') s
  from f
)
select doc_id, n::bigint n, form,
  case when form <> 'plain' then length(p)::bigint end prefix_chars,
  case when form <> 'plain' then length(m)::bigint end middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) output_sha256,
  sha256(case form when 'plain' then t else p || m || s end) restored_sha256
from cut
""",
)
def op13(spark, sf_dir):
    from spanline.llm.fill_middle import fill_middle, restore

    out = fill_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(
        "doc.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _importance_sql() -> str:
    """CRC-32 byte by byte, for the distinct features."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    words = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
    return rf"""
with crc as (
  select list(list_reduce(range(8)::bigint[], lambda c, k: {step}, i) order by i) t from range(256) x(i)
), words as (
  select 0 side, doc_id id, coalesce({words}, []) ws from documents
  union all select 1, item_id, coalesce({words}, []) from benchmark
), feature as (
  select side, id, g, count(*) n from (select side, id, unnest({runs}) g from words) group by all
), hexed as (
  select g, hex(encode(g)) x from (select distinct g from feature)
), bucket as (
  select g, xor(list_reduce(list_transform(range(1, length(x), 2), lambda j: ('0x' || substr(x, j, 2))::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 10000 b
  from hexed, crc
), counted as (
  select b, sum(n) filter (side = 0) s, sum(n) filter (side = 1) t from feature join bucket using (g) group by b
), every as (
  select coalesce(s, 0)::double s, coalesce(t, 0)::double t, i b from range(10000) x(i) left join counted on b = i
), total as (
  select sum(s) s_all, sum(t) t_all from every
), gain as (
  select b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint gain from every, total
), weighed as (
  select id, sum(n)::bigint n, sum(n * gain)::bigint weight
  from feature join bucket using (g) join gain using (b) where side = 0 group by id
), scored as (
  select id doc_id, len(ws) n_words, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  from words left join weighed using (id) where side = 0
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () n from scored where n_words >= 20
)
select doc_id, n_features::bigint n_features, weight::bigint weight, score::bigint score,
  case when r <= 5 * n // 100 then r end rank
from scored left join ranked using (doc_id)
"""


@query("op11_importance_resampling", _importance_sql())
def op11(spark, sf_dir):
    from spanline.llm.importance import resample

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc.doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_embedding_near_dedup",
    """
with recursive v as (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
  select vec_id, vec_id r from embeddings
  union
  select vec_id, b from reach join link on r = a
), c as (
  select vec_id, min(r) component_id from reach group by vec_id
), n as (
  select a, count(*) n from link group by a
)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept
from c left join n on a = vec_id
""",
)
def op12(spark, sf_dir):
    from spanline.llm.embedding_dedup import near_vectors

    out = near_vectors(table(spark, sf_dir, "embeddings"), ["vec_id"])
    return out.select("doc.vec_id", "n_links", "component_id", "kept")
