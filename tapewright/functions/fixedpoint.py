"""Decimal strings and scaled integers. Prices have four decimals (1.0000 is 10000), counts two; nothing is a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS = 24
MOST_WHOLE = 10**12


def _scaled(s: Column, decimals: int) -> Column:
    """Digits with at most `decimals` after the point, as an integer; null for anything else. ".5" and "5." are numbers."""
    whole, frac = F.regexp_extract(s, r"^([0-9]*)", 1), F.regexp_extract(s, r"\.([0-9]*)$", 1)
    number = F.coalesce(F.when(whole == "", F.lit("0")).otherwise(whole).try_cast("decimal(24,0)"), F.lit(0).cast("decimal(24,0)"))
    value = number.cast("decimal(24,0)") * F.lit(10**decimals) + F.when(frac == "", F.lit("0")).otherwise(F.rpad(frac, decimals, "0")).try_cast("decimal(10,0)")
    legal = s.rlike(rf"^([0-9]+(\.[0-9]{{0,{decimals}}})?|\.[0-9]{{1,{decimals}}})$") & (F.length(s) <= MOST_CHARS) & (number <= MOST_WHOLE)
    return F.when(legal, value.cast("bigint"))


def parse_price_e4(s: Column) -> Column:
    """ "0.0800" -> 800; null outside [0, 1], for signs, junk and more than four decimals."""
    v = _scaled(s, 4)
    return F.when((v >= 0) & (v <= 10000), v).cast("int")


def parse_count_fp(s: Column) -> Column:
    """ "300.00" -> 30000; null for signs."""
    return _scaled(s, 2)


def parse_delta_fp(s: Column) -> Column:
    """ "-54.00" -> -5400; one sign may lead."""
    v = _scaled(F.regexp_replace(s, r"^[+-]", ""), 2)
    return F.when(s.startswith("-"), -v).otherwise(v)


def format_price_e4(v: Column) -> Column:
    return F.format_string("%d.%04d", (v / 10000).cast("int"), (v % 10000).cast("int"))


def format_count_fp(v: Column) -> Column:
    a = F.abs(v.cast("bigint"))
    return F.concat(F.when(v < 0, "-").otherwise(""), F.format_string("%d.%02d", F.floor(a / 100), a % 100))


def cents_to_e4(c: Column) -> Column:
    return c.cast("int") * 100


def e4_to_cents(v: Column) -> Column:
    return F.floor((v + 50) / 100).cast("int")
