"""Normalising functions of the market-data pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw codes (characters of the source) to normalised codes.
ORDER_KINDS = {"D": 2, "S": 4, "1": 1, "2": 1, "3": 1, "A": 1}
TRADE_KINDS = {"1": 2, "2": 3}
ORDER_SIDES = {"0": 1, "1": 2}
TRADE_SIDES = {"0": 0, "1": 1, "2": 2}
VENUES = {1: 1, 2: 2}
#: Symbol suffixes of venues and their prefixes.
SUFFIXES = {1: (".SH", ".XSHG"), 2: (".SZ", ".XSHE")}
OTHER_VENUE = 9


def coded(raw: Column, codes: dict) -> Column:
    """The code of a raw value, 0 for others; raw may be a byte's number or a character."""
    out = F.lit(0)
    for k, v in codes.items():
        key = ord(k) if isinstance(k, str) else k
        out = F.when(raw == key, v).otherwise(out)
    return out.cast("int")


def digits_of(symbol: Column) -> Column:
    return F.substring(F.regexp_replace(symbol, "[^0-9]", ""), 1, 6)


def symbol_code(symbol: Column, strict: bool = True) -> Column:
    """Six digits with the venue's prefix before; fewer digits raise, or give null if not strict."""
    trimmed = F.trim(F.regexp_replace(symbol, "^\\x00+|\\x00+$", ""))
    digits = digits_of(trimmed)
    prefix = F.lit(OTHER_VENUE)
    for venue, ends in SUFFIXES.items():
        hit = F.lit(False)
        for e in ends:
            hit = hit | trimmed.endswith(e)
        prefix = F.when(hit, venue).otherwise(prefix)
    fail = F.raise_error(F.concat(F.lit("invalid_input: symbol without a six-digit code: "), symbol)).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.length(digits) == 6, (prefix * 1_000_000 + digits.cast("int")).cast("int")).when(symbol.isNotNull(), fail)


def day_key(raw_time: Column) -> Column:
    """The first eight digits of a raw time's magnitude."""
    return F.substring(F.abs(raw_time).cast("string"), 1, 8).cast("int")


def positive_rounded(value: Column, factor: int = 1) -> Column:
    """value * factor rounded half away from zero; 0 unless finite and positive."""
    good = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(good, F.round(F.when(good, value) * factor).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def price_cents(price: Column) -> Column:
    return positive_rounded(price, 100)


def volume(value: Column) -> Column:
    return positive_rounded(value)
