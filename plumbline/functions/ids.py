"""Stable short ids: 32-bit hashes to base 36, and digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def _folded(text: Column, start: int, step) -> Column:
    number = F.aggregate(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), F.lit(start).cast("bigint"), lambda h, c: step(h, F.ascii(c).cast("bigint")).bitwiseAND(F.lit(_MASK)))
    return F.lower(F.conv(number.cast("string"), 10, 36))


def xor33(text: Column) -> Column:
    """h * 33 xor c from 5381."""
    return _folded(text, 5381, lambda h, c: (h * 33).bitwiseXOR(c))


def polynomial(text: Column, factor: int = 31) -> Column:
    """h * factor + c from 0."""
    return _folded(text, 0, lambda h, c: h * factor + c)


def fnv1a(text: Column) -> Column:
    """(h xor c) times the FNV prime from the FNV offset."""
    return _folded(text, 2166136261, lambda h, c: h.bitwiseXOR(c) * 16777619)


def digest_id(text: Column, prefix: str = "", most: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.coalesce(text, F.lit("")).cast("binary")), 1, most))
