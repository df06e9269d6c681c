"""Keys in which differently written numbers and orders are compared. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes taken off invoice numbers, and look-alike characters of scans.
DEFAULT_PREFIXES = ("INVOICE", "INV", "NO", "NR", "NUM", "REF")
LOOK_ALIKE_FROM = "OQDILSBZG"
LOOK_ALIKE_TO = "000115826"

#: White space as browsers see it; Java's \s lacks the no-break and typographic spaces.
WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SEP = rf"[{WS}\-_/.#:,]"


def clean_prefixes(written: str | list[str] | None) -> list[str]:
    """Prefixes as typed in a setting, in capitals, without separators, longest first, each once."""
    import re

    parts = written if isinstance(written, (list, tuple)) else re.split(r"[,;\n]+", written or "")
    plain = [re.sub(r"[\s\-_/.#:,]+", "", str(p).upper()) for p in parts]
    return sorted(dict.fromkeys(p for p in plain if p), key=len, reverse=True)


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def match_key(c: Column, prefixes: tuple[str, ...] | list[str] = DEFAULT_PREFIXES) -> Column:
    """The form in which invoice numbers are equal: no separators, prefix or leading zeros. '' for null."""
    head = F.regexp_replace(F.upper(trim_ws(F.coalesce(c.cast("string"), F.lit("")))), rf"^[#{WS}]+", "")
    if prefixes:
        head = F.regexp_replace(head, rf"^(?:{'|'.join(prefixes)})(?={SEP}+.*\d|\d)", "")
    return F.regexp_replace(F.regexp_replace(head, rf"{SEP}+", ""), r"^0+(?=.)", "")


def po_key(c: Column) -> Column:
    """A purchase order without punctuation and without PO before a digit. '' for null."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", ""), r"^PO(?=\d)", "")


def look_alike_key(c: Column) -> Column:
    """Letters that scans confuse with digits, as those digits."""
    return F.translate(F.upper(c), LOOK_ALIKE_FROM, LOOK_ALIKE_TO)


def known_key(c: Column) -> Column:
    """Numbers of a known list: capitals, no white space, no trailing - _ /."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{WS}]+", "")), r"[-_/]+$", "")


def written_differently(a: Column, b: Column) -> Column:
    """Whether two numbers differ beyond white space and letter case."""
    plain = lambda c: F.regexp_replace(F.upper(trim_ws(F.coalesce(c, F.lit("")))), rf"[{WS}]+", " ")
    return plain(a) != plain(b)


def vendor_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
