"""Pieces of DuckDB SQL shared by the checks. DuckDB's patterns have no look-around, so captures stand in for it."""

from __future__ import annotations

W = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SEP = rf"[{W}\-_/.#:,]"


def trim(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[{W}]+|[{W}]+$', '', 'g')"


def match_key(x: str) -> str:
    head = rf"regexp_replace(upper({trim(x)}), '^[#{W}]+', '')"
    cut = rf"regexp_replace({head}, '^(?:INVOICE|INV|NO|NR|NUM|REF)({SEP}+.*[0-9]|[0-9])', '\1')"
    return rf"regexp_replace(regexp_replace({cut}, '{SEP}+', '', 'g'), '^0+(.)', '\1')"


def po_key(x: str) -> str:
    return rf"regexp_replace(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]', '', 'g'), '^PO([0-9])', '\1')"


def look_alike(x: str) -> str:
    return f"translate(upper({x}), 'OQDILSBZG', '000115826')"


def known(x: str) -> str:
    return rf"regexp_replace(upper(regexp_replace(coalesce({x}, ''), '[{W}]+', '', 'g')), '[-_/]+$', '')"


def currency(x: str) -> str:
    return rf"case when regexp_matches({x}, '(?i)€|\bEUR\b') then 'EUR' when regexp_matches({x}, '(?i)£|\bGBP\b') then 'GBP' when regexp_matches({x}, '(?i)\bCHF\b') then 'CHF' when regexp_matches({x}, '(?i)\$|\bUSD\b') then 'USD' end"


def money(x: str, codes: str = "EUR|GBP|CHF|USD", need: bool = True) -> str:
    """An amount as DECIMAL(20,2): parse_money, or with ``need`` off the form for typed registers."""
    rest = trim(rf"regexp_replace({x}, '(?i)€|£|\$|\b(?:{codes})\b', '', 'g')")
    digits = f"regexp_replace({rest}, '[^0-9.,]', '', 'g')"
    decimal = rf"regexp_matches({digits}, '[.,][0-9]{{1,2}}$')"
    whole = rf"regexp_replace(case when {decimal} then regexp_replace({digits}, '[.,][0-9]{{1,2}}$', '') else {digits} end, '[.,]', '', 'g')"
    sign = rf"case when regexp_matches({rest}, '^[-(]|-$') then '-' else '' end"
    text = rf"concat({sign}, case when {whole} = '' then '0' else {whole} end, case when {decimal} then concat('.', regexp_extract({digits}, '[.,]([0-9]{{1,2}})$', 1)) else '' end)"
    if need:
        ok = rf"regexp_matches({rest}, '^[-(]?[{W}]*[0-9][0-9.,''{W}]*\)?-?$') and ({decimal} or ({currency(x)}) is not null)"
    else:
        ok = rf"regexp_matches({rest}, '^-?[{W}]*[-(]?[{W}]*[0-9][0-9.,''’{W}]*\)?-?$')"
    return f"case when {ok} then try_cast({text} as decimal(20, 2)) end"


def shape(x: str) -> str:
    runs = rf"regexp_extract_all(upper(coalesce({x}, '')), '[A-Z]+|[0-9]+|[^A-Z0-9\s]')"
    return rf"array_to_string(list_transform({runs}, lambda r: case when regexp_matches(r, '^[A-Z]') then concat('A', length(r)) when regexp_matches(r, '^[0-9]') then concat('D', length(r)) else r end), ' ')"


#: Aging buckets.
BUCKET = "case when days_left is null then null when days_left <= -91 then 'late90' when days_left <= -61 then 'late60' when days_left <= -31 then 'late30' when days_left <= -1 then 'late1' when days_left <= 7 then 'week' when days_left <= 30 then 'month' else 'later' end"


def wilson(p: str, n: str) -> str:
    return f"case when {n} = 0 then 0.0 else (({p} * 1.0::double / {n}) + 1.96*1.96/(2.0::double*{n}) - 1.96 * sqrt(({p} * 1.0::double / {n}) * (1 - ({p} * 1.0::double / {n})) / {n} + 1.96*1.96/(4.0::double*{n}*{n}))) / (1 + 1.96*1.96/{n}::double) end"
