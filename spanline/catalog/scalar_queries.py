"""Scalar functions inside table jobs (H-01 .. H-38, PRJ-01 .. PRJ-10, FLT-03/05/08/09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.catalog.registry import query
from spanline.catalog.stand_ins import FRAMES, frames, table
from spanline.catalog.vote_queries import SEQS, seqs
from spanline.functions import arrays as ar
from spanline.functions import html as ht
from spanline.functions import text as tx
from spanline.functions import tokens as tk
from spanline.operators import tables as tb
from spanline.session import small_table
from spanline.timeunits import ceil_to, floor_to, micros, safe_round

VOCAB = ["click", "error", "purchase", "signup", "view"]


@query(
    "prj01_mask_labels",
    """with b as (select event_id, event_type as game, case when value > 50 then 'zoom' else 'not_zoom' end as left_bar,
   'm' || (event_id % 3)::varchar as map from events)
select event_id, game, case when game in ('error', 'signup') then 'n/a' when game = 'view' then 'not_zoom'
  when game = 'purchase' then 'n/a' else left_bar end as left_bar,
  case when game in ('error', 'signup') then 'n/a' else map end as map from b""",
)
def mask_labels(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("game"),
        F.when(F.col("value") > 50, "zoom").otherwise("not_zoom").alias("left_bar"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("map"),
    )
    rules = small_table(
        spark,
        [
            ("game", "error", "left_bar", "n/a"),
            ("game", "error", "map", "n/a"),
            ("game", "signup", "left_bar", "n/a"),
            ("game", "signup", "map", "n/a"),
            ("game", "view", "left_bar", "not_zoom"),
            ("game", "purchase", "left_bar", "n/a"),
        ],
        "when_col string, when_val string, target string, value string",
    )
    return tb.mask_labels(df, rules)


@query(
    "prj02_mask_unknown",
    """select event_id, h as hero, case when h = 'n/a' then 'n/a' else u end as ult,
  case when h = 'n/a' then 'n/a' else a end as alive from (select event_id,
   case when event_type = 'error' then 'n/a' else event_type end as h,
   'u' || (event_id % 2)::varchar as u, 'a' || (event_id % 3)::varchar as a from events)""",
)
def mask_unknown(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("event_type")).alias("hero"),
        F.concat(F.lit("u"), (F.col("event_id") % 2).cast("string")).alias("ult"),
        F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("alive"),
    )
    return tb.mask_unknown(df, "hero", ["ult", "alive"])


@query(
    "prj04_hex_to_rgb",
    """select o_orderkey, ((o_orderkey * 977 % 16777216) // 65536)::int as r,
  ((o_orderkey * 977 % 16777216) // 256 % 256)::int as g, (o_orderkey * 977 % 16777216 % 256)::int as b from orders""",
)
def hex_to_rgb(spark, sf):
    code = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("o_orderkey") * 977 % 16777216), 6, "0")))
    df = table(spark, sf, "orders").select("o_orderkey", tb.hex_to_rgb(code).alias("c"))
    return df.select("o_orderkey", *[F.col("c")[i].alias(n) for i, n in enumerate("rgb")])


@query(
    "prj05_scale_signed",
    """select vec_id, round(list_sum(list_transform(embedding, lambda x: (x::double / 255 - 0.5) / 0.5)), 5) as total,
  round((embedding[7]::double / 255 - 0.5) / 0.5, 6) as seventh from embeddings""",
)
def scale_signed(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", ar.scale_signed("embedding").alias("s"))
    return df.select(
        "vec_id",
        F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
        F.round(F.col("s")[6], 6).alias("seventh"),
    )


@query(
    "prj06_canonical_color",
    """with c as (select o_orderkey, ['white','red','blue','green'][o_orderkey % 4 + 1] as color,
   ['white','red','blue'][o_custkey % 3 + 1] as l, ['white','orange'][o_orderkey // 4 % 2 + 1] as r from orders)
select o_orderkey, case when (l = 'white' or r = 'white') and color <> 'white'
  then case when l <> 'white' then l else r end else color end as color from c""",
)
def canonical_color(spark, sf):
    def pick(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    color = pick(["white", "red", "blue", "green"], k % 4)
    left = pick(["white", "red", "blue"], c % 3)
    right = pick(["white", "orange"], F.floor(k / 4) % 2)
    return table(spark, sf, "orders").select(
        "o_orderkey", tb.canonical_color(color, left, right).alias("color")
    )


@query(
    "prj07_canonical_pair",
    """with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, s.n_name as a, c.n_name as b,
    case l_returnflag when 'A' then 'Team1wins' when 'R' then 'Team2wins' else 'Draw' end as result
  from lineitem join supplier on s_suppkey = l_suppkey join nation s on s.n_nationkey = s_nationkey
  join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation c on c.n_nationkey = c_nationkey)
select l_orderkey, l_linenumber, least(a, b) as a, greatest(a, b) as b,
  case when a > b and result = 'Team1wins' then 'Team2wins' when a > b and result = 'Team2wins' then 'Team1wins'
  else result end as result, case when a > b then l_suppkey else l_partkey end as r1,
  case when a > b then l_partkey else l_suppkey end as r2 from m""",
)
def canonical_pair(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    supp = table(spark, sf, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.col("n_name").alias("a"))
    cust = table(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_name").alias("b"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        cust, F.col("o_custkey") == F.col("c_custkey")
    )
    m = (
        table(spark, sf, "lineitem")
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "l_orderkey", "l_linenumber", "a", "b",
            F.when(F.col("l_returnflag") == "A", "Team1wins")
            .when(F.col("l_returnflag") == "R", "Team2wins").otherwise("Draw").alias("result"),
            F.col("l_partkey").alias("r1"), F.col("l_suppkey").alias("r2"),
        )
    )
    return tb.canonical_pair(
        m, "a", "b", "result", {"Team1wins": "Team2wins", "Team2wins": "Team1wins"}, [("r1", "r2")]
    )


@query(
    "prj08_correct_clock",
    f"""with {FRAMES}, o as (select distinct grp, grp * 1000000 as off from frames where grp % 3 = 0)
select f.event_id, f.grp, case when off is not null then t - off
  when k::bigint * 100000 - 2000000 > 2000000 then t + k::bigint * 100000 - 2000000 else t end as t
from frames f left join o using (grp)""",
)
def correct_clock(spark, sf):
    f = frames(spark, sf)
    off = f.filter(F.col("grp") % 3 == 0).select(
        "grp", (F.col("grp") * 1_000_000).alias("offset")
    ).distinct()
    f = f.select(
        "event_id", "grp", "t", F.lit(2_000_000).cast("bigint").alias("declared"),
        (F.col("k").cast("bigint") * 100_000).alias("actual"),
    )
    return tb.correct_clock(f, off, "grp", "t", "declared", "actual").select("event_id", "grp", "t")


@query(
    "prj10_side_code",
    """select o_orderkey, case o_orderstatus when 'F' then 'left' when 'O' then 'right' else 'neither' end as side,
 case o_orderstatus when 'F' then 'L' when 'O' then 'R' else 'N' end as code from orders""",
)
def side_code(spark, sf):
    code = F.when(F.col("o_orderstatus") == "F", "L").when(
        F.col("o_orderstatus") == "O", "R"
    ).otherwise("N")
    df = table(spark, sf, "orders").select("o_orderkey", tb.side_code(code).alias("side"))
    return df.withColumn("code", tb.side_code("side"))


@query(
    "flt03_usable_rounds",
    """select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'F') and o_orderkey >= 9359
  and o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 7)""",
)
def usable_rounds(spark, sf):
    from spanline.operators.joins import skip_processed

    df = tb.usable_rounds(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"),
        "o_orderkey", "o_orderstatus", ["O", "F"], 9359,
    )
    done = table(spark, sf, "lineitem").filter("l_linenumber = 7").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    return skip_processed(df, done, "o_orderkey")


@query("flt05_drop_blank", f"with {SEQS} select conv_id, len(seq)::int as n from seqs where len(seq) <> 1")
def drop_blank(spark, sf):
    return tb.drop_blank(seqs(spark, sf).select("conv_id", F.size("seq").alias("n")), "n")


@query(
    "flt08_allow_deny",
    """select o_orderkey from orders where o_custkey not in (1, 2, 3, 5, 8) and o_orderdate::date <= date '1999-06-30'
  and o_orderpriority not like '%NOT%'""",
)
def allow_deny(spark, sf):
    return tb.allow_deny(
        table(spark, sf, "orders"), "o_custkey", deny=[1, 2, 3, 5, 8], date="o_orderdate",
        until="1999-06-30", title="o_orderpriority", without="NOT",
    ).select("o_orderkey")


@query(
    "flt09_prefix_suffix",
    """select p_partkey, p_brand, p_type from part where p_brand like 'Brand#1%' or p_type like '%MO'""",
)
def prefix_suffix(spark, sf):
    return table(spark, sf, "part").filter(
        F.col("p_brand").startswith("Brand#1") | F.col("p_type").endswith("MO")
    ).select("p_partkey", "p_brand", "p_type")


@query(
    "h01_string_basics",
    """select c_custkey, lower(trim(replace(c_name, '#', ' - '))) || ' vs ' || split_part(c_name, '#', 2) as label
from customer""",
)
def string_basics(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.format_string(
            "%s vs %s",
            F.lower(F.trim(F.replace("c_name", F.lit("#"), F.lit(" - ")))),
            F.split_part("c_name", F.lit("#"), F.lit(2)),
        ).alias("label"),
    )


CODES = ["DAL", "PHI", "SEO", "LDN", "SFS"]

TITLES = """titles as (select o_orderkey, o_orderkey % 8 as kind,
   ['overwatchcontenders','Overwatch Contenders','OverwatchLeague','owlettournament','OWLET tournament','rivalcade','other','other'][o_orderkey % 8 + 1] as channel,
   'Nation ' || (o_custkey % 25)::varchar as a, 'Nation ' || (o_orderkey % 25)::varchar as b,
   ['DAL','PHI','SEO','LDN','SFS'][o_custkey % 5 + 1] as ca, ['DAL','PHI','SEO','LDN','SFS'][o_orderkey // 8 % 5 + 1] as cb,
   (o_orderkey % 7 + 1)::varchar as g from orders)"""


def titles(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))

    channels = [
        "overwatchcontenders", "Overwatch Contenders", "OverwatchLeague", "owlettournament",
        "OWLET tournament", "rivalcade", "other", "other",
    ]
    a = F.concat(F.lit("Nation "), (c % 25).cast("string"))
    b = F.concat(F.lit("Nation "), (k % 25).cast("string"))
    g = (k % 7 + 1).cast("string")
    ca, cb = pick(CODES, c % 5), pick(CODES, F.floor(k / 8) % 5)
    forms = [
        F.concat(a, F.lit(" vs "), b, F.lit(" | Group A Game "), g, F.lit(" | Week 2: East | Season 3")),
        F.concat(F.lit(" "), a, F.lit(" V "), b, F.lit(" (Part 1)")),
        F.concat(F.lit("Game #"), g, F.lit(" "), ca, F.lit(" @ "), cb, F.lit(" | Stage 1")),
        F.concat(F.lit("Cup 4 - "), a, F.lit(" vs. "), b),
        F.concat(F.lit("Cup 4: "), a, F.lit(" vs "), b),
        F.concat(F.lit("Finals, "), a, F.lit(" VS "), b),
        F.concat(F.lit("[Open] "), a, F.lit(" Vs "), b, F.lit(" - Day 1")),
        F.lit("no teams in here"),
    ]
    kind = k % 8
    title = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        title = F.when(kind == i, f).otherwise(title)
    return table(spark, sf, "orders").select(
        "o_orderkey", pick(channels, kind).alias("channel"), title.alias("title")
    )


@query(
    "h02_parse_title",
    f"""with {TITLES},
m as (select * from (values ('DAL','Dallas Fuel'),('PHI','Philadelphia Fusion'),('SEO','Seoul Dynasty'),
  ('LDN','London Spitfire'),('SFS','San Francisco Shock')) v(code, name))
select o_orderkey, case kind when 2 then m1.name when 6 then a when 7 then null else a end as team_one,
  case kind when 2 then m2.name when 6 then b || ' - Day 1' when 7 then null else b end as team_two,
  case when kind = 0 then 'Group A' end as description, case when kind in (0, 2) then g end as game_number,
  case when kind = 0 then 'Season 3 - Week 2: East' end as event
from titles left join m m1 on m1.code = ca left join m m2 on m2.code = cb""",
)
def parse_title(spark, sf):
    return titles(spark, sf).select(
        "o_orderkey", tx.parse_title("channel", "title").alias("p")
    ).select("o_orderkey", "p.*")


@query(
    "h03_expand_team_code",
    """select c_custkey, case c_custkey % 4 when 0 then 'Dallas Fuel' when 1 then 'Chengdu Hunters'
  when 2 then 'Guangzhou Charge' end as team from customer""",
)
def expand_team_code(spark, sf):
    k = F.col("c_custkey") % 4
    code = F.when(k == 0, "DAL").when(k == 1, "CHE").when(k == 2, "GUA").otherwise("XXX")
    return table(spark, sf, "customer").select("c_custkey", tx.expand_team_code(code).alias("team"))


@query(
    "h04_h05_text_dates",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as ordinal, strftime(o_orderdate, '%Y-%m-%d') as long,
  null::varchar as bad from orders""",
)
def text_dates(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    ordinal = F.concat(
        F.dayofmonth(d).cast("string"), F.lit("th of "), F.date_format(d, "MMMM"), F.lit(" "),
        F.year(d).cast("string"),
    )
    long = F.date_format(d, "MMMM d, yyyy")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(tx.parse_ordinal_date(ordinal), "yyyy-MM-dd").alias("ordinal"),
        F.date_format(tx.parse_long_date(long), "yyyy-MM-dd").alias("long"),
        F.date_format(tx.parse_long_date(F.col("o_orderpriority")), "yyyy-MM-dd").alias("bad"),
    )


@query(
    "h06_patch_name",
    """select o_orderkey, case when o_orderkey % 3 = 0 then '1.' || (o_orderkey % 40)::varchar || '.0.2b'
  when o_orderkey % 3 = 1 then '1.' || (o_orderkey % 40)::varchar
  else 'Beta_' || year(o_orderdate)::varchar || '_' || month(o_orderdate)::varchar || '_' || day(o_orderdate)::varchar end as patch
from orders""",
)
def patch_name(spark, sf):
    k = F.col("o_orderkey")
    n = (k % 40).cast("string")
    head = (
        F.when(k % 3 == 0, F.concat(F.lit("Patch 1."), n, F.lit(".0.2b (PC only)")))
        .when(k % 3 == 1, F.concat(F.lit("1."), n))
        .otherwise(F.lit("Hotfix"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", tx.patch_name(head, F.col("o_orderdate").cast("date")).alias("patch")
    )


@query(
    "h07_durations",
    """select event_id, case when event_id % 2 = 0 then (event_id % 5) * 3600 else 0 end + (event_id % 60) * 60 + event_id % 47 as iso,
  case when event_id % 2 = 0 then (event_id % 5) * 3600 else 0 end + (event_id % 60) * 60 + event_id % 47 as clock from events""",
)
def durations(spark, sf):
    k = F.col("event_id")
    h, m, s = (k % 5).cast("string"), (k % 60).cast("string"), (k % 47).cast("string")
    iso = F.concat(
        F.lit("PT"), F.when(k % 2 == 0, F.concat(h, F.lit("H"))).otherwise(""), m, F.lit("M"), s, F.lit("S")
    )
    clock = F.concat(
        F.when(k % 2 == 0, F.concat(h, F.lit("h"))).otherwise(""), m, F.lit("m"), s, F.lit("s")
    )
    return table(spark, sf, "events").select(
        "event_id", tx.iso_duration_seconds(iso).alias("iso"), tx.clock_seconds(clock).alias("clock")
    )


@query(
    "h08_h09_timestamps",
    """select event_id, strftime(ts, '%Y-%m-%d') as day, ts > timestamp '2024-01-15 12:00:00' as late from events""",
)
def timestamps(spark, sf):
    ms = F.floor(micros("ts") / 1000)
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    cut = F.lit("2024-01-15T12:00:00Z")
    return table(spark, sf, "events").select(
        "event_id",
        F.date_format(tx.ms_to_date(ms), "yyyy-MM-dd").alias("day"),
        (tx.parse_iso(iso) > tx.parse_iso(cut)).alias("late"),
    )


@query(
    "h10_formatters",
    """select event_id, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) as h_mm_ss,
  printf('%02d_%02d.%d', u // 60000000, u // 1000000 % 60, u // 100000 % 10) as mm_ss,
  printf('%dh %dm', event_id // 60, event_id % 60) as hm
from (select event_id, epoch_us(ts) % 86400000000 as u, epoch_us(ts) % 86400000000 // 1000000 as s from events)""",
)
def formatters(spark, sf):
    u = F.pmod(micros("ts"), F.lit(86_400_000_000))
    return table(spark, sf, "events").select(
        "event_id", tx.h_mm_ss(u).alias("h_mm_ss"), tx.mm_ss(u).alias("mm_ss"),
        tx.hours_minutes(F.col("event_id")).alias("hm"),
    )


@query(
    "h11_days_between",
    """select o_orderkey, l_linenumber, date_diff('day', o_orderdate::date, l_shipdate::date)::int as days,
  round(date_diff('day', date '1995-01-01', o_orderdate::date) / 2500.0, 6)::double as fraction
from orders join lineitem on l_orderkey = o_orderkey""",
)
def days_between(spark, sf):
    j = table(spark, sf, "orders").join(
        table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    return j.select(
        "o_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").alias("days"),
        F.round(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 2500.0, 6).alias("fraction"),
    )


@query(
    "h13_levenshtein",
    """select c_custkey, levenshtein(c_mktsegment, upper(n_name))::int as d from customer
join nation on c_nationkey = n_nationkey""",
)
def levenshtein(spark, sf):
    j = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return j.select("c_custkey", F.levenshtein("c_mktsegment", F.upper("n_name")).alias("d"))


@query(
    "h14_jamo",
    """with c as (select c_custkey, c_name, (c_custkey * 7919) % 11172 as n from customer)
select c_custkey, chr((44032 + n)::int) || c_name as name, substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', n // 588 + 1, 1)
  || substr('ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ', n % 588 // 28 + 1, 1)
  || case when n % 28 = 0 then '' else substr('ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ', n % 28, 1) end
  || c_name as letters, chr((44032 + n)::int) || c_name as joined from c""",
)
def jamo(spark, sf):
    """Names with a Hangul syllable picked by key, split into letters and joined again."""
    k = F.col("c_custkey")
    syllable = F.expr("decode(unhex(hex(44032 + (c_custkey * 7919) % 11172)), 'UTF-16BE')")
    df = table(spark, sf, "customer").select(
        k, F.concat(syllable, F.col("c_name")).alias("name")
    )
    df = df.withColumn("letters", tx.split_jamo("name"))
    return df.withColumn("joined", tx.join_jamo("letters"))


@query(
    "h15_correct_name",
    """select c_custkey, ['hooreg','geguri','highly','customer'][c_custkey % 4 + 1] as name from customer""",
)
def correct_name(spark, sf):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "hooeg").when(k == 1, "gegture").when(k == 2, "fioply").otherwise("customer")
    return table(spark, sf, "customer").select("c_custkey", tx.correct_name(raw).alias("name"))


@query(
    "h17_rounding_and_gcd",
    """with r as (select event_id, epoch_us(ts) as u, event_id % 12 + 1 as a, event_id % 18 + 1 as b from events)
select event_id, u // 100000 * 100000 as floored, (u + 99999) // 100000 * 100000 as ceiled,
  case when u % 100000 * 2 > 100000 or (u % 100000 * 2 = 100000 and u // 100000 % 2 = 1)
    then u // 100000 + 1 else u // 100000 end * 100000 as rounded, gcd(gcd(a * 6, b * 4), 24) as gcd from r""",
)
def rounding_and_gcd(spark, sf):
    u, k = micros("ts"), F.col("event_id")
    steps = F.array((k % 12 + 1) * 6, (k % 18 + 1) * 4, F.lit(24).cast("bigint"))
    return table(spark, sf, "events").select(
        "event_id", floor_to(u, 100_000).alias("floored"), ceil_to(u, 100_000).alias("ceiled"),
        safe_round(u, 100_000).alias("rounded"), ar.gcd_of(steps).alias("gcd"),
    )


@query("h18_clamp", "select event_id, least(greatest(value, 5.0), 100.0)::double as v from events")
def clamp(spark, sf):
    return table(spark, sf, "events").select("event_id", ar.clamp("value", 5.0, 100.0).alias("v"))


@query(
    "h19_points_total",
    """select p_partkey, case when split_part(p_brand, '#', 2)::int - 1 > 0 then split_part(p_brand, '#', 2)::int - 1
  + case when p_size % 2 = 0 then 2 else 3 end * ((p_size - 1) // 2) end::bigint as points from part""",
)
def points_total(spark, sf):
    mode = F.when(F.col("p_size") % 2 == 0, "Assault_").otherwise("Escort_")
    status = F.concat(mode, F.split_part("p_brand", F.lit("#"), F.lit(2)))
    return table(spark, sf, "part").select("p_partkey", tx.points_total(status, "p_size").alias("points"))


@query(
    "h20_first_text",
    """select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g')) as title,
  trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) as h1,
  trim(regexp_replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '<[^>]*>', '', 'g')) as ad,
  null::varchar as missing from pages""",
)
def first_text(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", ht.first_text("html", "title").alias("title"), ht.first_text("html", "h1").alias("h1"),
        ht.first_text("html", "div", "class", "ad").alias("ad"),
        ht.first_text("html", "div", "id", "none").alias("missing"),
    )


@query(
    "h21_links",
    """with n as (select page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) as nav from pages),
l as (select page_id, regexp_extract_all(nav, '(?s)<a[^>]*>(.*?)</a>', 1) as t,
   regexp_extract_all(nav, '<a[^>]*href="([^"]*)"', 1) as h from n)
select page_id, lower(trim(t[i])) as text, h[i] as href, (i - 1)::int as pos from l, unnest(generate_series(1, len(t))) g(i)""",
)
def links(spark, sf):
    nav = ht.container("html", "nav")
    pairs = F.arrays_zip(ht.link_texts(nav).alias("t"), ht.link_hrefs(nav).alias("h"))
    return table(spark, sf, "pages").select("page_id", F.posexplode(pairs).alias("pos", "l")).select(
        "page_id", F.lower(F.col("l.t")).alias("text"), F.col("l.h").alias("href"), "pos"
    )


@query(
    "h22_query_id",
    """select page_id, nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '')::bigint as id from pages""",
)
def query_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", ht.query_id("url", "page").alias("id"))


@query(
    "h23_map_scores",
    """with w as (select page_id, page_id % 3 as w, page_id % 2 = 1 as flip, lower(regexp_extract(url, '/(\\w\\w)/', 1)) as m from pages)
select page_id, m || ':' || case when w = 0 then 'Draw' when (w = 1) <> flip then 'Team1wins' else 'Team2wins' end as scores from w""",
)
def map_scores(spark, sf):
    k = F.col("page_id")
    block = F.concat(
        F.lit('<div class="map-score"><div class="mapname" title="'),
        F.upper(F.regexp_extract("url", r"/(\w\w)/", 1)),
        F.lit('"></div><div class="score1'), F.when(k % 3 == 1, " winner").otherwise(""),
        F.lit('"></div><div class="score2'), F.when(k % 3 == 2, " winner").otherwise(""),
        F.lit('"></div></div>'),
    )
    page = F.concat("html", block)
    scores = ht.map_scores(page, k % 2 == 1)
    return table(spark, sf, "pages").select(
        "page_id",
        F.array_join(F.transform(scores, lambda s: F.concat_ws(":", s["map"], s["result"])), ",").alias("scores"),
    )


@query(
    "h24_embedded_json",
    "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
)
def embedded_json(spark, sf):
    page = F.concat(F.lit("<script>x = x.concat(["), F.col("props"), F.lit("]);y=2;</script>"))
    df = table(spark, sf, "events").select(
        "event_id", ht.embedded_json(page, "x = x.concat(", ");y", "array<struct<k:int>>").alias("j")
    )
    return df.select("event_id", F.col("j")[0]["k"].alias("k"))


@query("h25_error_pages", "select page_id from pages where not contains(lower(html), 'eheed')")
def error_pages(spark, sf):
    return table(spark, sf, "pages").filter(~ht.is_error_page("html", "eheed")).select("page_id")


@query(
    "h26_page_text",
    r"""with a as (select page_id, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') as h from pages),
b as (select page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as h from a),
c as (select page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as h from b)
select page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) as text from c""",
)
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", ht.page_text("html").alias("text"))


@query(
    "h27_json_access",
    """select event_id, cast(json_extract_string(props, '$.k') as int) as k, props like '%"k"%' as has_k from events""",
)
def json_access(spark, sf):
    m = F.from_json("props", "map<string,int>")
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.map_contains_key(m, "k").alias("has_k"),
    )


@query(
    "h28_array_ops",
    f"""with {SEQS} select conv_id, list_contains(seq, 'assistant') as has,
  array_to_string(case when list_contains(seq, 'system') then seq else list_append(seq, 'system') end, ',') as appended,
  array_to_string(list_reverse(seq)[1:3], ',') as newest, array_to_string(seq[2:], ',') as rest from seqs""",
)
def array_ops(spark, sf):
    return seqs(spark, sf).select(
        "conv_id", F.array_contains("seq", "assistant").alias("has"),
        F.array_join(ar.append_if_absent("seq", F.lit("system")), ",").alias("appended"),
        F.array_join(ar.first_k_reversed("seq", 3), ",").alias("newest"),
        F.array_join(ar.drop_first("seq"), ",").alias("rest"),
    )


@query(
    "h29_map_ops",
    """select p_partkey, case p_type when 'PROMO' then 'p' when 'ECONOMY' then 'e' else 'none' end as code,
  p_brand as from_patch, p_type as kept, 'size' as inverted from part""",
)
def map_ops(spark, sf):
    base = F.create_map(F.lit("a"), F.col("p_type"), F.lit("b"), F.lit("x"))
    both = ar.override(base, F.create_map(F.lit("b"), F.col("p_brand")))
    inv = ar.invert(F.create_map(F.lit("size"), F.col("p_size")))
    return table(spark, sf, "part").select(
        "p_partkey", ar.lookup({"PROMO": "p", "ECONOMY": "e"}, "p_type", "none").alias("code"),
        F.element_at(both, "b").alias("from_patch"), F.element_at(both, "a").alias("kept"),
        F.element_at(inv, F.col("p_size")).alias("inverted"),
    )


@query(
    "h30_same_fields",
    """select l_orderkey, l_linenumber, l_returnflag is not distinct from l_linestatus
  and (l_partkey % 2 = l_suppkey % 2) as same from lineitem""",
)
def same_fields(spark, sf):
    a = F.struct(F.col("l_returnflag").alias("x"), (F.col("l_partkey") % 2).alias("y"))
    b = F.struct(F.col("l_linestatus").alias("x"), (F.col("l_suppkey") % 2).alias("y"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ar.same_fields(a, b, ["x", "y"]).alias("same")
    )


@query(
    "h31_argmax_label",
    """select vec_id, 'c' || (list_position(embedding, list_max(embedding)) - 1)::varchar as label from embeddings""",
)
def argmax_label(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", ar.argmax_label("embedding", [f"c{i}" for i in range(64)]).alias("label")
    )


@query(
    "h32_log_softmax",
    """with s as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
n as (select vec_id, v, ln(list_sum(list_transform(v, lambda x: exp(x)))) as z from s)
select vec_id, round(v[1] - z, 6) as first, round(list_sum(v) - 64 * z, 5) as total from n""",
)
def log_softmax(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", ar.log_softmax("embedding").alias("s")
    )
    return df.select(
        "vec_id", F.round(F.col("s")[0], 6).alias("first"),
        F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
    )


IDS = """ids as (select l_orderkey, list(l_quantity::int % 4 order by l_linenumber, l_partkey, l_quantity) as a
   from lineitem group by 1)"""


def id_arrays(spark, sf):
    from spanline.catalog.stand_ins import layout_for
    from spanline.operators.votes import ordered_arrays

    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        (F.col("l_quantity").cast("int") % 4).alias("id"),
    )
    return ordered_arrays(
        li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "id", "a",
        layout_for(spark, sf, "lineitem", "l_orderkey"),
    ).drop("part")


@query(
    "h33_ctc_collapse",
    f"""with {IDS} select l_orderkey, coalesce(array_to_string(list_filter(a, lambda x, i: x <> 0 and (i = 1 or a[i - 1] <> x)), ','), '') as ids from ids""",
)
def ctc_collapse(spark, sf):
    return id_arrays(spark, sf).select(
        "l_orderkey", F.array_join(ar.ctc_collapse("a"), ",").alias("ids")
    )


@query(
    "h36_pad_sequence",
    f"""with {IDS} select l_orderkey, array_to_string((a || [4, 4, 4, 4, 4, 4])[1:6], ',') as padded,
  coalesce(array_to_string(list_transform(list_filter(list_transform((a || [4, 4, 4, 4, 4, 4])[1:6], lambda x: least(x, 3)), lambda x: x <> 3), lambda x: x + 1), ','), '') as train
from ids""",
)
def pad_sequence(spark, sf):
    df = id_arrays(spark, sf).withColumn("p", ar.pad_sequence("a", 6, 4))
    return df.select(
        "l_orderkey", F.array_join("p", ",").alias("padded"),
        F.array_join(ar.training_sequence("p", 3), ",").alias("train"),
    )


TOKENS = """tok as (select event_id, k, event_type as h, ['left','right'][k % 2 + 1] as s1, ['right','left'][k % 2 + 1] as s2,
   ['click','view','error','turret_npc'][k % 4 + 1] as v,
   ['primary','melee','blast','blast headshot','dash'][k % 5 + 1] as ab, k % 3 = 0 as has_assist, k % 7 = 0 as env, k % 9 <> 0 as known
   from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"""

ALLOWED = {
    "click": ["primary", "melee", "blast"],
    "view": ["primary", "melee", "dash"],
    "error": ["primary", "melee"],
    "purchase": ["primary", "blast", "dash"],
    "signup": ["primary"],
}
ABILITIES = ["primary", "melee", "blast", "blast headshot", "dash"]


def token_rows(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")

    def pick(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)

    df = table(spark, sf, "events").select(
        "event_id", k.alias("k"), F.col("event_type").alias("h"),
        pick(["left", "right"], k % 2).alias("s1"), pick(["right", "left"], k % 2).alias("s2"),
        pick(["click", "view", "error", "turret_npc"], k % 4).alias("v"),
        pick(ABILITIES, k % 5).alias("ab"),
    )
    none = F.array().cast("array<string>")
    kk = F.col("k")
    tokens = F.concat(
        F.when(
            kk % 9 != 0,
            F.concat(
                F.array("s1", "h"),
                F.when(kk % 3 == 0, F.array(F.lit("view_assist"), F.lit("error_assist"))).otherwise(none),
            ),
        ).otherwise(none),
        F.array("ab"),
        F.when(kk % 7 == 0, F.array(F.lit("environmental"))).otherwise(none),
        F.array("v", "s2"),
    )
    return df.withColumn("tokens", tokens)


PARSED = """parsed as (select event_id, case when known then h end as first_hero, case when known then s1 end as first_side,
  case when known and has_assist then array_to_string(list_filter(['view', 'error'], lambda x: x <> h), ',') else '' end as assists,
  case when known and not list_contains(case h when 'click' then ['primary','melee','blast'] when 'view' then ['primary','melee','dash']
     when 'error' then ['primary','melee'] when 'purchase' then ['primary','blast','dash'] else ['primary'] end, replace(ab, ' headshot', ''))
     then 'primary' else replace(ab, ' headshot', '') end as ability,
  env as environmental, ab like '%headshot' as headshot, replace(v, '_npc', '') as second_hero, s2 as second_side from tok)"""


@query("h34_parse_event", f"with {TOKENS}, {PARSED} select * from parsed")
def parse_event(spark, sf):
    return token_rows(spark, sf).select(
        "event_id", tk.parse_event("tokens", VOCAB, ABILITIES, ALLOWED).alias("p")
    ).select(
        "event_id", "p.first_hero", "p.first_side", F.array_join("p.assists", ",").alias("assists"),
        "p.ability", "p.environmental", "p.headshot", "p.second_hero", "p.second_side",
    )


@query(
    "h35_encode_event",
    f"""with {TOKENS}, {PARSED} select event_id, case when first_hero is null then '' else first_side || ',' || first_hero || ','
   || case when assists <> '' then replace(assists, ',', '_assist,') || '_assist,' else '' end end
   || ability || case when headshot then ' headshot' else '' end || ',' || case when environmental then 'environmental,' else '' end
   || case when second_hero = 'turret' then 'turret_npc' else second_hero end || ',' || second_side as tokens from parsed""",
)
def encode_event(spark, sf):
    p = token_rows(spark, sf).select(
        "event_id", tk.parse_event("tokens", VOCAB, ABILITIES, ALLOWED).alias("p")
    )
    return p.select(
        "event_id", F.array_join(tk.encode_event("p", VOCAB, ["turret"]), ",").alias("tokens")
    )


@query(
    "ag15_semantic_accuracy",
    f"""with {TOKENS}, {PARSED} select sum((ability is not distinct from case when known then
   replace(ab, ' headshot', '') else replace(ab, ' headshot', '') end)::int)::bigint as correct, count(*) as total,
  round(sum((ability = replace(ab, ' headshot', ''))::int) / count(*), 6) as accuracy
from parsed join tok using (event_id)""",
)
def semantic_accuracy(spark, sf):
    from spanline.operators.evaluate import semantic_accuracy as accuracy

    anything = {h: [a.replace(" headshot", "") for a in ABILITIES] for h in VOCAB}
    df = token_rows(spark, sf).select(
        tk.parse_event("tokens", VOCAB, ABILITIES, ALLOWED).alias("a"),
        tk.parse_event("tokens", VOCAB, ABILITIES, anything).alias("b"),
    )
    out = accuracy(df, F.col("a"), F.col("b"), ["first_hero", "ability", "second_hero", "second_side"])
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "h37_label_index",
    """select event_id, (list_position(['click','error','purchase','signup','view'], event_type) - 1)::int as id from events""",
)
def label_index(spark, sf):
    from spanline.operators.features import label_index as index_of

    vocab = table(spark, sf, "events").select(F.col("event_type").alias("label")).distinct()
    return index_of(
        table(spark, sf, "events").select("event_id", F.col("event_type").alias("label")), "label", vocab
    ).select("event_id", F.col("label_id").alias("id"))


@query(
    "h38_one_hot",
    """select vec_id, array_to_string(list_transform(range(10), lambda x: (x = label)::int), '') as hot from embeddings""",
)
def one_hot(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array_join(ar.one_hot("label", 10), "").alias("hot")
    )
