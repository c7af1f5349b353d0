"""Reading landed HTML pages with SQL string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity -> character, the ones a text extract needs; ``&amp;`` last.
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unescape(text: str | Column) -> Column:
    out = _c(text)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_tags(html: str | Column) -> Column:
    return F.regexp_replace(_c(html), r"<[^>]*>", "")


def first_text(html: str | Column, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Text of the first ``tag`` (optionally with an attribute word); NULL if there is none."""
    where = rf'[^>]*\b{attr}="(?:[^"]*\s)?{value}(?:\s[^"]*)?"' if attr else ""
    pattern = rf"(?s)<{tag}\b{where}[^>]*>(.*?)</{tag}>"
    hit = F.regexp_extract(_c(html), pattern, 1)
    found = F.regexp_like(_c(html), F.lit(pattern))
    return F.when(found, F.trim(strip_tags(hit)))


def container(html: str | Column, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Inner HTML of the first ``tag``; empty if there is none."""
    where = rf'[^>]*\b{attr}="(?:[^"]*\s)?{value}(?:\s[^"]*)?"' if attr else ""
    return F.regexp_extract(_c(html), rf"(?s)<{tag}\b{where}[^>]*>(.*?)</{tag}>", 1)


def link_texts(fragment: str | Column) -> Column:
    raw = F.regexp_extract_all(_c(fragment), F.lit(r"(?s)<a\b[^>]*>(.*?)</a>"), 1)
    return F.transform(raw, lambda x: F.trim(strip_tags(x)))


def link_hrefs(fragment: str | Column) -> Column:
    return F.regexp_extract_all(_c(fragment), F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), 1)


def query_id(url: str | Column, param: str = "id") -> Column:
    """Number of a query parameter; NULL if absent."""
    hit = F.nullif(F.regexp_extract(_c(url), rf"[?&]{param}=(\d+)", 1), F.lit(""))
    return hit.cast("bigint")


def map_scores(html: str | Column, flip: Column) -> Column:
    """Array of ``(map, result)``: the side whose score cell is marked ``winner``.

    ``flip`` tells that the two teams were swapped.
    """
    # Class names of the score table and the three results.
    pattern = r"(?s)<div class=\"map-score\">.*?</div>\s*</div>"
    blocks = F.regexp_extract_all(_c(html), F.lit(f"({pattern})"), 1)

    def result(block: Column) -> Column:
        one = F.regexp_like(block, F.lit(r'class="[^"]*\bscore1\b[^"]*\bwinner\b'))
        two = F.regexp_like(block, F.lit(r'class="[^"]*\bscore2\b[^"]*\bwinner\b'))
        first, second = F.lit("Team1wins"), F.lit("Team2wins")
        return (
            F.when(one, F.when(flip, second).otherwise(first))
            .when(two, F.when(flip, first).otherwise(second))
            .otherwise(F.lit("Draw"))
        )

    return F.transform(
        blocks,
        lambda blk: F.struct(
            F.lower(F.regexp_extract(blk, r'class="mapname"[^>]*title="([^"]*)"', 1)).alias("map"),
            result(blk).alias("result"),
        ),
    )


def embedded_json(html: str | Column, prefix: str, suffix: str, schema: str) -> Column:
    """JSON between two literal markers of a script, parsed."""
    after = F.split_part(_c(html), F.lit(prefix), F.lit(2))
    return F.from_json(F.split_part(after, F.lit(suffix), F.lit(1)), schema)


def is_error_page(html: str | Column, marker: str = "not found") -> Column:
    return F.lower(_c(html)).contains(marker)


def page_text(html: str | Column) -> Column:
    """Text without scripts, styles, comments and tags, spaces collapsed."""
    out = F.regexp_replace(_c(html), r"(?s)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(out), r"\s+", " "))
