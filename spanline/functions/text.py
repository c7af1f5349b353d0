"""Titles, dates, durations and names as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanline.functions.arrays import let, lookup

# Team code -> team name.
TEAM_CODES = {
    "DAL": "Dallas Fuel",
    "PHI": "Philadelphia Fusion",
    "SEO": "Seoul Dynasty",
    "LDN": "London Spitfire",
    "SFS": "San Francisco Shock",
    "HOU": "Houston Outlaws",
    "BOS": "Boston Uprising",
    "VAL": "Los Angeles Valiant",
    "GLA": "Los Angeles Gladiators",
    "FLA": "Florida Mayhem",
    "SHD": "Shanghai Dragons",
    "NYE": "New York Excelsior",
    "PAR": "Paris Eternal",
    "TOR": "Toronto Defiant",
    "WAS": "Washington Justice",
    "VAN": "Vancouver Titans",
    "CDH": "Chengdu Hunters",
    "HZS": "Hangzhou Spark",
    "ATL": "Atlanta Reign",
    "GZC": "Guangzhou Charge",
    "CHE": "Chengdu Hunters",
    "GUA": "Guangzhou Charge",
    "HAN": "Hangzhou Spark",
}

# Misread name -> name.
MISREAD_NAMES = {
    "hooeg": "hooreg",
    "jecsee": "jecse",
    "nosmie": "nosmite",
    "dacdo": "daco",
    "gegturi": "geguri",
    "gegture": "geguri",
    "coneipten": "onlywish",
    "conewphek": "onlywish",
    "onwoish": "onlywish",
    "onfoish": "onlywish",
    "onoish": "onlywish",
    "fradi": "fragi",
    "fiollt": "highly",
    "fioplt": "highly",
    "piopfet": "highly",
    "fiolhply": "highly",
    "fioply": "highly",
    "slaler": "scaler",
}

# Title patterns per channel, anchored at the start; the groups that
# hold team one, team two, description, game number, sub event and main event.
TITLE_PATTERNS = {
    "contenders": (
        r"^([-\w ']+) (vs|V) ([-\w ']+) \| ([\w ]+) Game (\d) \| (([\w :]+) \| )?([\w ]+)",
        {"team_one": 1, "team_two": 3, "description": 4, "game_number": 5, "sub": 7, "main": 8},
    ),
    "contenders_video": (
        r"^([-\w .']+) (vs|V) ([-\w .']+) (\(Part)?.*",
        {"team_one": 1, "team_two": 3},
    ),
    "league": (
        r"^Game [#]?(\d+) (\w+) @ (\w+) \| ([\w ]+)",
        {"game_number": 1, "team_one": 2, "team_two": 3},
    ),
    "dash": (r"^.* - ([-\w ']+) (vs[.]?|V) ([-\w ']+)", {"team_one": 1, "team_two": 3}),
    "colon": (r"^.*: ([-\w ']+) (vs[.]?|V) ([-\w ']+)", {"team_one": 1, "team_two": 3}),
    "comma": (
        r"^.*, ([-\w. '?]+) (vs[.]?|VS) ([-\w. '?]+)",
        {"team_one": 1, "team_two": 3},
    ),
    "any": (
        r"^(.*[-,:\]] )?([-\w '?.]+) [vV][sS][.]? ([-\w '?.]+)( [-:].*)?",
        {"team_one": 2, "team_two": 3},
    ),
}

# Channel name (lower case) -> pattern.
CHANNEL_PATTERN = {
    "overwatchcontenders": "contenders",
    "overwatchcontendersbr": "contenders",
    "overwatch contenders": "contenders_video",
    "overwatchleague": "league",
    "owlettournament": "dash",
    "owlet tournament": "colon",
    "rivalcade": "comma",
}

_TITLE_FIELDS = ("team_one", "team_two", "description", "game_number", "sub", "main")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _group(text: Column, pattern: str, group: int) -> Column:
    """Capture group, NULL where the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def expand_team_code(code: str | Column) -> Column:
    return lookup(TEAM_CODES, code, None)


def correct_name(name: str | Column) -> Column:
    """Known misreadings replaced."""
    return lookup(MISREAD_NAMES, name, _c(name))


def parse_title(channel: str | Column, title: str | Column) -> Column:
    """Struct of teams, description, game number and event read from a title.

    The channel picks the pattern; where that one does not match the general one
    is tried.  League titles hold team codes.
    """
    text = F.trim(_c(title))
    which = lookup(CHANNEL_PATTERN, F.lower(_c(channel)), None)

    def fields(name: str) -> Column:
        pattern, groups = TITLE_PATTERNS[name]
        cols = {f: F.lit(None).cast("string") for f in _TITLE_FIELDS}
        cols.update({f: _group(text, f"(?U){pattern}", g) for f, g in groups.items()})
        if name == "league":
            cols["team_one"] = expand_team_code(cols["team_one"])
            cols["team_two"] = expand_team_code(cols["team_two"])
        hit = F.regexp_like(text, F.lit(f"(?U){pattern}"))
        return F.when(hit, F.struct(*[cols[f].alias(f) for f in _TITLE_FIELDS]))

    by_channel = F.lit(None)
    for name in TITLE_PATTERNS:
        if name != "any":
            by_channel = F.when(which == name, fields(name)).otherwise(by_channel)

    def result(got: Column) -> Column:
        event = F.when(got["sub"].isNull(), got["main"]).otherwise(
            F.concat_ws(" - ", got["main"], got["sub"])
        )
        return F.struct(
            F.trim(got["team_one"]).alias("team_one"),
            F.trim(got["team_two"]).alias("team_two"),
            got["description"].alias("description"),
            got["game_number"].alias("game_number"),
            event.alias("event"),
        )

    return let(F.coalesce(by_channel, fields("any")), result)


def _month_number(name: Column) -> Column:
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(F.substring(name, 1, 3)))
    return F.lpad(at.cast("string"), 2, "0")


def _date(year: Column, month_name: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, _month_number(month_name), F.lpad(day, 2, "0"))
    return F.when(year.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def parse_ordinal_date(text: str | Column) -> Column:
    """Dates like ``3rd of June 2018``."""
    p = r"(\d+)\w{2} of (\w+) (\d+)"
    t = _c(text)
    return _date(_group(t, p, 3), _group(t, p, 2), _group(t, p, 1))


def parse_long_date(text: str | Column) -> Column:
    """Dates like ``June 3, 2018``."""
    p = r"^(\w+) (\d+), (\d+)"
    t = _c(text)
    return _date(_group(t, p, 3), _group(t, p, 1), _group(t, p, 2))


def patch_name(text: str | Column, date: str | Column) -> Column:
    """Version number at the head of a heading, else ``Beta_year_month_day``."""
    # Fixed value: the pattern of a version heading.
    pattern = r"^(patch )?([0-9.abcd]{2,})( [(]pc only[)])?"
    d = _c(date)
    beta = F.concat_ws(
        "_", F.lit("Beta"), F.year(d).cast("string"), F.month(d).cast("string"),
        F.dayofmonth(d).cast("string"),
    )
    return F.coalesce(_group(F.lower(_c(text)), pattern, 2), beta)


def _hms(t: Column, h: str, m: str, s: str) -> Column:
    def part(p: str, k: int) -> Column:
        return F.coalesce(_group(t, p, 1).cast("bigint") * k, F.lit(0))

    return part(h, 3600) + part(m, 60) + part(s, 1)


def iso_duration_seconds(text: str | Column) -> Column:
    """``PT#H#M#S`` to seconds."""
    t = _c(text)
    return F.when(t.startswith("PT"), _hms(t, r"(\d+)H", r"(\d+)M", r"(\d+)S"))


def clock_seconds(text: str | Column) -> Column:
    """``#h#m#s`` or ``#m#s`` to seconds."""
    return _hms(_c(text), r"(\d+)h", r"(\d+)m", r"(\d+)s")


def ms_to_date(ms: str | Column) -> Column:
    return F.to_date(F.timestamp_millis(_c(ms)))


def parse_iso(text: str | Column) -> Column:
    return F.try_to_timestamp(_c(text))


def _pad2(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def h_mm_ss(us: Column) -> Column:
    """Microseconds as ``H:MM:SS``."""
    s = F.floor(us / 1_000_000)
    return F.concat_ws(
        ":", F.floor(s / 3600).cast("string"), _pad2(F.pmod(F.floor(s / 60), F.lit(60))),
        _pad2(F.pmod(s, F.lit(60))),
    )


def mm_ss(us: Column) -> Column:
    """Microseconds as ``mm_ss.s``, tenths cut off."""
    tenths = F.floor(us / 100_000)
    return F.format_string(
        "%02d_%02d.%d",
        F.floor(tenths / 600),
        F.pmod(F.floor(tenths / 10), F.lit(60)),
        F.pmod(tenths, F.lit(10)),
    )


def hours_minutes(minutes: Column) -> Column:
    """Minutes as ``'{}h {}m'``."""
    return F.format_string(
        "%dh %dm", F.floor(minutes / 60).cast("bigint"), F.pmod(minutes, F.lit(60)).cast("bigint")
    )


def points_total(status: str | Column, round_number: str | Column) -> Column:
    """Points from ``Mode_n``: n - 1, plus those of earlier rounds; NULL while zero.

    Fixed values: two points a round in ``Assault``, three otherwise.
    """
    s = _c(status)
    own = F.substring_index(s, "_", -1).cast("bigint") - 1
    per = F.when(s.startswith("Assault_"), 2).otherwise(3)
    earlier = per * F.floor((_c(round_number) - 1) / 2)
    return F.when(own > 0, own + earlier)


# Unicode block of composed Hangul syllables and the compatibility
# letters in the order of their index.
_SYLLABLES = 0xAC00
_LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def _split_word(word: str) -> str:
    out = []
    for ch in word:
        n = ord(ch) - _SYLLABLES
        if 0 <= n < len(_LEADS) * len(_VOWELS) * len(_TAILS):
            lead, rest = divmod(n, len(_VOWELS) * len(_TAILS))
            vowel, tail = divmod(rest, len(_TAILS))
            out.append(_LEADS[lead] + _VOWELS[vowel] + (_TAILS[tail] if tail else ""))
        else:
            out.append(ch)
    return "".join(out)


def _join_word(word: str) -> str:
    out, i, n = [], 0, len(word)
    while i < n:
        if word[i] in _LEADS and i + 1 < n and word[i + 1] in _VOWELS:
            code = (_LEADS.index(word[i]) * len(_VOWELS) + _VOWELS.index(word[i + 1])) * len(_TAILS)
            i += 2
            # a consonant belongs to this syllable unless a vowel follows it
            if i < n and word[i] in _TAILS[1:] and not (i + 1 < n and word[i + 1] in _VOWELS):
                code += _TAILS.index(word[i])
                i += 1
            out.append(chr(_SYLLABLES + code))
        else:
            out.append(word[i])
            i += 1
    return "".join(out)


def _each_once(names: pd.Series, fn: Callable[[str], str]) -> pd.Series:
    """``fn`` of each name, computed once for those that repeat."""
    return names.map({name: fn(name) for name in names.dropna().unique()}, na_action="ignore")


def _split_series(names: pd.Series) -> pd.Series:
    return _each_once(names, _split_word)


def _join_series(names: pd.Series) -> pd.Series:
    return _each_once(names, _join_word)


def split_jamo(name: str | Column) -> Column:
    """Hangul syllables to compatibility letters; other characters stay."""
    return F.pandas_udf(_split_series, "string")(_c(name))


def join_jamo(name: str | Column) -> Column:
    """Compatibility letters back to syllables."""
    return F.pandas_udf(_join_series, "string")(_c(name))
