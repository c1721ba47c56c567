"""Seeded draws as pure column expressions.

A draw depends on the seed, the row's id and a tag, and on nothing else. The same
row therefore gets the same values whatever the partitioning, on a retried task
and on a recomputed partition, where ``rand()`` would not.

Hashing and reading the hash as a number are the cost of a draw. One digest is
therefore read as two halves of 60 bits, and each half serves two draws: a wide
one of 44 bits for digits and amounts, a narrow one of 16 bits for picks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_DIGITS = 15
_NARROW_BITS = 16
_WIDE_BITS = 4 * _HALF_DIGITS - _NARROW_BITS
# At most this many decimal digits come from one wide draw; the bias from the
# remainder then stays below 1e-4.
DIGITS_PER_DRAW = 9


def digest(seed: int, row_id: Column, tag: str) -> Column:
    """The hash that the draws called ``tag`` of one row are taken from.

    Give digests a projection of their own, and their halves another, so that
    each is computed once for all its draws.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), F.lit(tag)))


def half(hashed: Column, which: int) -> Column:
    """Half 0 or 1 of a digest as an integer."""
    text = F.substring(hashed, 1 + which * _HALF_DIGITS, _HALF_DIGITS)
    return F.conv(text, 16, 10).cast("bigint")


def wide(number: Column) -> Column:
    """The upper 44 bits of a half."""
    return F.shiftright(number, _NARROW_BITS)


def narrow(number: Column) -> Column:
    """The lower 16 bits of a half."""
    return number.bitwiseAND(F.lit(2**_NARROW_BITS - 1))


def digits(numbers: Sequence[Column], length: int) -> Column:
    """G1: ``length`` decimal digits as text, leading zeros kept, nine from each wide draw."""
    if length < 0:
        raise ValueError(f"a text of {length} digits")
    parts = []
    for drawn in numbers:
        width = min(length - DIGITS_PER_DRAW * len(parts), DIGITS_PER_DRAW)
        if width > 0:
            parts.append(F.lpad((drawn % F.lit(10**width)).cast("string"), width, "0"))
    if length > DIGITS_PER_DRAW * len(numbers):
        raise ValueError(f"{length} digits need more than {len(numbers)} draws")
    return F.concat(*parts) if parts else F.lit("")


def uniform(drawn: Column, low: float, high: float) -> Column:
    """A double in [low, high) from a wide draw."""
    if not low < high:
        raise ValueError(f"no values between {low} and {high}")
    return F.lit(float(low)) + drawn / F.lit(float(2**_WIDE_BITS)) * F.lit(float(high) - float(low))


def pick(drawn: Column, values: Sequence[str]) -> Column:
    """One of a fixed list of values, as many as a narrow draw can tell apart."""
    if not 0 < len(values) <= 2**_NARROW_BITS:
        raise ValueError(f"{len(values)} values to pick from, not 1 to {2**_NARROW_BITS}")
    place = (drawn % F.lit(len(values)) + 1).cast("int")
    return F.element_at(F.array(*map(F.lit, values)), place)


def pick_for(drawn: Column, key: Column, values: Mapping[str, Sequence[str]]) -> Column:
    """One of the values listed for the row's own ``key``; null for an unlisted key."""
    if not all(0 < len(items) <= 2**_NARROW_BITS for items in values.values()):
        raise ValueError(f"a list without values, or with more than {2**_NARROW_BITS}")
    lists = F.create_map(
        *[c for k, items in values.items() for c in (F.lit(k), F.array(*map(F.lit, items)))]
    )
    listed = F.try_element_at(lists, key)
    place = (drawn % F.size(listed) + 1).cast("int")
    return F.element_at(listed, place)


def epoch_millis(value: Column) -> Column:
    """A timestamp with time zone as epoch milliseconds, in text."""
    return F.unix_millis(value).cast("string")
