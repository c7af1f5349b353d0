"""Time as BIGINT microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(col: str | Column) -> Column:
    """Microseconds since the epoch; accepts TIMESTAMP and TIMESTAMP_NTZ (UTC session)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def safe_round(us: str | Column, tick: int) -> Column:
    """Nearest multiple of ``tick``, halves to the even multiple, as Python rounds."""
    c = F.col(us) if isinstance(us, str) else us
    rest = F.pmod(c, F.lit(tick))
    q = ((c - rest) / F.lit(tick)).cast("bigint")
    rest2 = rest * 2
    up = (rest2 > tick) | ((rest2 == tick) & (F.pmod(q, F.lit(2)) == 1))
    return (q + F.when(up, 1).otherwise(0)) * F.lit(tick)


def floor_to(us: str | Column, step: int) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return c - F.pmod(c, F.lit(step))


def ceil_to(us: str | Column, step: int) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return c + F.pmod(-c, F.lit(step))


def close_right(end: str | Column, tick: int) -> Column:
    """Turn "time of the last sample" into an exclusive end."""
    c = F.col(end) if isinstance(end, str) else end
    return c + F.lit(tick)
