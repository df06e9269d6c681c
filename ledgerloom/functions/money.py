"""Amounts of money as printed, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.keys import WS, trim_ws


def currency_of(c: Column) -> Column:
    """EUR, GBP, CHF or USD when the text names it, in that order; else null."""
    hit = lambda pattern: c.rlike(pattern)
    return (
        F.when(hit(r"(?i)€|\bEUR\b"), "EUR")
        .when(hit(r"(?i)£|\bGBP\b"), "GBP")
        .when(hit(r"(?i)\bCHF\b"), "CHF")
        .when(hit(r"(?i)\$|\bUSD\b"), "USD")
    )


def _plain(c: Column, codes: str) -> tuple[Column, Column, Column]:
    rest = trim_ws(F.regexp_replace(c, rf"(?i)€|£|\$|\b(?:{codes})\b", ""))
    digits = F.regexp_replace(rest, "[^0-9.,]", "")
    return rest, digits, digits.rlike(r"[.,]\d{1,2}$")


def _value(rest: Column, digits: Column, decimal: Column) -> Column:
    whole = F.regexp_replace(F.when(decimal, F.regexp_replace(digits, r"[.,]\d{1,2}$", "")).otherwise(digits), "[.,]", "")
    text = F.concat(
        F.when(rest.rlike(r"^[-(]|-$"), "-").otherwise(""),
        F.when(whole == "", "0").otherwise(whole),
        F.when(decimal, F.concat(F.lit("."), F.regexp_extract(digits, r"[.,](\d{1,2})$", 1))).otherwise(""),
    )
    return text.try_cast("decimal(20,2)")


def parse_money(c: Column) -> Column:
    """A printed sum as DECIMAL(20,2), null when the text isn't one.

    The last separator is the decimal mark when one or two digits follow it. A whole number without a currency is a count,
    not a sum, and gives null. ( ) and a minus at either end make it negative.
    """
    rest, digits, decimal = _plain(c, "EUR|GBP|CHF|USD")
    ok = rest.rlike(rf"^[-(]?[{WS}]*\d[\d.,'{WS}]*\)?-?$") & (decimal | currency_of(c).isNotNull())
    return F.when(ok, _value(rest, digits, decimal))


def sheet_amount(c: Column) -> Column:
    """An amount cell: parse_money, else a plain number with commas left out."""
    return F.coalesce(parse_money(c), F.regexp_replace(trim_ws(c), ",", "").try_cast("decimal(20,2)"))


def typed_amount(c: Column) -> Column:
    """An amount as typed into a register, with or without currency and decimals; null when blank or no number."""
    rest, digits, decimal = _plain(c, "EUR|GBP|CHF|USD|PLN")
    return F.when(rest.rlike(rf"^-?[{WS}]*[-(]?[{WS}]*\d[\d.,'’{WS}]*\)?-?$"), _value(rest, digits, decimal))
