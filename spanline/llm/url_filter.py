"""URL filter lists with dates: every capture is judged by the entries active when it was fetched.

A list is a table of dated entries ``key, day, action``: ``add`` puts a key on the list,
``remove`` takes it off.  A key is a host, a parent domain, or a host with the first part
of a path.  The last entry of a key on or before a day decides; of entries of one day,
``remove``.

1. Entries become validity intervals: an ``add`` holds from its day until the key's next
   entry.  They do not overlap within a key.
2. A capture asks for its few keys (host, parent domains, host and first part of the path).
3. Captures meet intervals by key and month, so that neither a popular host nor a key
   with a long history multiplies rows: a capture finds at most one interval for a key.
   Spark splits a month of a popular host in the join.

A capture without url, host or day matches nothing and is allowed.  Entries without key or
day, or of another action, are void.  Repeated rows of captures each get the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.ordered import Next, scan

OPEN_END = "9999-12-31"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; NULL if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1))
    found = F.regexp_replace(found, r"\.$", "")
    return F.when(found != "", found)


def path_start(url: Column) -> Column:
    """First part of the path; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def url_keys(url: Column) -> Column:
    """Keys an entry for this url may have: host and parent domains of two labels or more, host/path."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(labels, k, n), "."),
    )
    path = path_start(url)
    whole = F.when(path != "", F.array(F.concat(host(url), F.lit("/"), path))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parents, whole))


def validity(entries: DataFrame) -> DataFrame:
    """``key, begin, end`` (end excluded) during which a key is on the list."""
    good = entries.filter("key is not null and day is not null and action in ('add', 'remove')")
    last = good.groupBy("key", "day").agg(F.max("action").alias("action"))
    spans = scan(last, ["key"], ["day"], {"end": Next("day")})
    return spans.filter("action = 'add'").select(
        "key", F.col("day").alias("begin"), F.coalesce("end", F.lit(OPEN_END).cast("date")).alias("end")
    )


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """A struct ``capture`` of the columns of ``captures``, ``blocked``, the longest active ``rule``, ``since``."""
    rows = captures.select(
        F.struct(*[captures[c] for c in captures.columns]).alias("capture"),
        F.col(url).alias("_url"),
        F.col(day).cast("date").alias("_day"),
    )
    asked = (
        rows.filter("_url is not null and _day is not null")
        .select("_url", "_day")
        .distinct()
        .select("_url", "_day", F.explode(url_keys(F.col("_url"))).alias("_key"), _month(F.col("_day")).alias("_at"))
    )
    # open intervals reach up to the last capture
    last = captures.agg(F.max(_month(F.col(day).cast("date")))).first()[0] or 0
    until = F.least(_month(F.date_sub("end", 1)), F.lit(last))
    months = validity(entries).withColumn("_until", until).filter(_month(F.col("begin")) <= F.col("_until")).select(
        "key", "begin", "end", F.explode(F.sequence(_month(F.col("begin")), F.col("_until"))).alias("month")
    )
    hits = asked.join(
        months,
        (F.col("_key") == F.col("key"))
        & (F.col("_at") == F.col("month"))
        & (F.col("begin") <= F.col("_day"))
        & (F.col("_day") < F.col("end")),
    )
    best = F.max(F.struct(F.char_length("key").alias("n"), "key", "begin")).alias("_best")
    verdicts = hits.groupBy(F.col("_url").alias("_u"), F.col("_day").alias("_d")).agg(best)
    return rows.join(verdicts, (F.col("_url") == F.col("_u")) & (F.col("_day") == F.col("_d")), "left").select(
        "capture",
        F.col("_best").isNotNull().alias("blocked"),
        F.col("_best.key").alias("rule"),
        F.col("_best.begin").alias("since"),
    )


def allowed(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` that no entry blocks."""
    return judge(captures, entries, url, day).filter("not blocked").select("capture.*")
