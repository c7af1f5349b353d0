"""Array, map and struct expressions over labels, scores and id sequences."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind an expression once and use it several times inside another."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def argmax_index(scores: str | Column) -> Column:
    """0-based position of the first maximum."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def argmax_label(scores: str | Column, vocab: Sequence[str]) -> Column:
    """Vocabulary entry of the first maximum."""
    return F.element_at(F.array(*[F.lit(v) for v in vocab]), argmax_index(scores) + 1)


def log_softmax(scores: str | Column) -> Column:
    """Scores minus the log of the sum of their exponentials (shifted by the maximum)."""
    s = F.transform(_c(scores), lambda x: x.cast("double"))
    top = F.array_max(s)
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(s, lambda x: x - top - F.log(total))


def scale_signed(values: str | Column) -> Column:
    """Bytes 0..255 to -1..1, elementwise."""
    return F.transform(_c(values), lambda x: (x.cast("double") / 255 - 0.5) / 0.5)


def ctc_collapse(ids: str | Column, blank: int = 0) -> Column:
    """Drop blanks and immediate repeats of an id sequence."""
    a = _c(ids)
    # element_at counts from 1, so position i holds the element before index i
    return F.filter(
        a,
        lambda x, i: (x != blank)
        & ((i == 0) | (x != F.element_at(a, F.greatest(i, F.lit(1))))),
    )


def encode_labels(tokens: str | Column, index: Column) -> Column:
    """Tokens to ids through a map column."""
    return F.transform(_c(tokens), lambda x: F.element_at(index, x))


def pad_sequence(ids: str | Column, size: int, pad: int) -> Column:
    """First ``size`` ids, filled up with ``pad``."""
    a = _c(ids)
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad), size)), 1, size)


def training_sequence(padded: str | Column, blank: int) -> Column:
    """Ids above ``blank`` clipped to it, blanks removed, the rest shifted up by one."""
    clipped = F.transform(_c(padded), lambda x: F.least(x, F.lit(blank)))
    return F.transform(F.filter(clipped, lambda x: x != blank), lambda x: x + 1)


def append_if_absent(arr: str | Column, value: str | Column) -> Column:
    a, v = _c(arr), _c(value)
    return F.when(F.array_contains(a, v), a).otherwise(F.array_append(a, v))


def drop_first(arr: str | Column) -> Column:
    a = _c(arr)
    return F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))


def first_k_reversed(arr: str | Column, k: int) -> Column:
    """Newest first: the last ``k`` entries in reverse order."""
    return F.slice(F.reverse(_c(arr)), 1, k)


def lookup(mapping: Mapping[str, str], key: str | Column, default: str | Column | None) -> Column:
    """Map literal lookup with a default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), _c(key))
    if default is None:
        return hit
    return F.coalesce(hit, F.lit(default) if isinstance(default, str) else default)


def override(base: str | Column, patch: str | Column) -> Column:
    """Map union in which the second map wins."""
    keep = F.map_filter(_c(base), lambda k, v: ~F.map_contains_key(_c(patch), k))
    return F.map_concat(keep, _c(patch))


def invert(mapping: str | Column) -> Column:
    """Swap keys and values; values must be distinct."""
    m = _c(mapping)
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))


def same_fields(a: str | Column, b: str | Column, fields: Sequence[str]) -> Column:
    """Null-safe equality of the named struct fields."""
    out = F.lit(True)
    for f in fields:
        out = out & _c(a)[f].eqNullSafe(_c(b)[f])
    return out


def one_hot(index: str | Column, n: int) -> Column:
    i = _c(index)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x == i).cast("int"))


def gcd_of(steps: str | Column) -> Column:
    """Greatest common divisor of an array of positive steps."""

    def pair(a, b):
        # a step has at most 63 bits, so 90 division rounds are more than enough
        rounds = F.sequence(F.lit(1), F.lit(90))
        zero = F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y"))
        end = F.aggregate(
            rounds,
            zero,
            lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(
                F.struct(
                    acc["y"].alias("x"),
                    F.pmod(acc["x"], F.greatest(acc["y"], F.lit(1))).alias("y"),
                )
            ),
        )
        return end["x"]

    return F.aggregate(_c(steps), F.lit(0).cast("bigint"), pair)


def clamp(x: str | Column, low, high) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))
