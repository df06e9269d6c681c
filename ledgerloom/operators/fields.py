"""Fields of an invoice read behind their labels: total, dates, terms, purchase order, customer; and labels learnt from examples.

A page is a list of phrases: pieces of text close enough together to be read as one, each with its place; without a layout each
line is one. An Arrow-batched function lists, for each field, what stands behind its labels, in the order in which it is to be
tried (beside the label, to its right, below it); which of these is the value is decided by the same expressions that read
money, dates and terms everywhere else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money
from ledgerloom.functions.keys import po_key

# The gap within a phrase in font sizes, lines below a label, and how far a column may reach.
PHRASE_GAP, LINES_BELOW, COLUMN_REACH = 1.2, 3, 20.0

# Labels of the fields; those of the total by how telling they are.
TOTALS = (
    ("total due", "total amount due", "amount due", "balance due", "total payable", "amount payable", "balance"),
    (
        "invoice total", "grand total", "total amount", "total invoice amount", "total invoice", "invoice amount", "invoice amt", "invoice value", "inv amount", "inv amt", "net payable", "total incl vat", "total incl tax",
        "total including vat", "total including tax", "total usd", "total eur", "total gbp", "total chf", "gesamtbetrag", "montant total", "importe total", "totale", "totaal",
    ),
    ("total",),
)
LABELS = {
    "date": ("invoice date", "date of invoice", "issue date", "date of issue", "date issued", "invoice dt", "billing date", "rechnungsdatum", "date de facturation", "fecha de factura", "fecha", "data fattura", "factuurdatum", "datum", "date"),
    "due": ("payment due date", "payment due", "due date", "date due", "due by", "due", "fälligkeit", "fällig", "échéance", "vencimiento", "vervaldatum"),
    "terms": ("payment terms of payment", "payment terms", "terms of payment", "terms", "zahlungsbedingungen", "conditions de paiement", "condiciones de pago", "betalingsvoorwaarden"),
    "po": ("purchase order number", "purchase order no", "purchase order ref", "purchase order reference", "purchase order", "customer po", "po number", "po no", "po ref", "po reference", "po", "p o", "order number", "order no", "order ref", "order reference", "bestellnummer", "bon de commande"),
    "customer": ("bill to", "billed to", "invoice to", "sold to", "ship to", "shipped to", "customer", "client", "kunde", "rechnungsempfänger", "facturé à", "cliente", "klant"),
}
# Words behind a label that make it another one.
OTHERWISE = {
    "total": ("vat", "tax", "excl", "before", "net", "ht", "qty", "quantity", "items", "hours", "weight"),
    "date": ("due", "paid", "of payment"),
    "po": ("box",),
    "customer": ("id", "no", "number", "#", "code", "ref", "account"),
}
# Words that say a phrase is about terms, wherever it stands.
TERMS_ANYWHERE = ("net ", "within ", "on receipt", "eom")


@dataclass
class Phrase:
    text: str
    x: float
    end_x: float
    band: int
    end: int = 0


def phrases(text: str, spans: list[dict] | None = None) -> list[Phrase]:
    """The phrases of a page, line by line from the left."""
    if not spans:
        return [Phrase(line.strip(), 0.0, 0.0, band) for band, line in enumerate(text.split("\n")) if line.strip()]
    out: list[Phrase] = []
    for s in sorted(spans, key=lambda s: (s["band"], s["x"])):
        piece, last = text[s["start"] : s["end"]], out[-1] if out else None
        if last and last.band == s["band"] and s["x"] - last.end_x < PHRASE_GAP * (s["font"] or 10):
            last.text = " ".join(f"{last.text}{' ' if s['start'] > last.end else ''}{piece}".split(" "))
            last.end_x, last.end = max(last.end_x, s["end_x"]), s["end"]
        else:
            out.append(Phrase(piece.strip(), s["x"], s["end_x"], s["band"], s["end"]))
    return [p for p in out if p.text]


def label_end(text: str, label: str, otherwise: tuple[str, ...] = ()) -> int | None:
    """Where a label ends that a phrase starts with, None if it doesn't: its words in order, marks between them or none at
    all, no letter or digit behind, and none of the words that make it another label."""
    at, low = 0, text.lower()
    for w in label.lower().split():
        at += len(re.match(r"[\s.:#-]*", low[at:])[0]) if at else 0
        if not low.startswith(w, at):
            return None
        at += len(w)
    if low[at : at + 1].isalnum():
        return None
    rest = low[at:].lstrip(" .")
    if any(rest.startswith(w) and not rest[len(w) : len(w) + 1].isalpha() for w in otherwise):
        return None
    return at


def behind(page: list[Phrase], labels: tuple[str, ...] | list[str], otherwise: tuple[str, ...] = (), right: bool = True, below: bool = True) -> list[str]:
    """What stands with any of some labels, phrase by phrase: the rest of its own phrase, the next one on its line, the first
    one under it."""
    out = []
    for i, p in enumerate(page):
        end = next((e for label in sorted(labels, key=len, reverse=True) if (e := label_end(p.text, label, otherwise)) is not None), None)
        if end is None:
            continue
        rest = p.text[end:].lstrip(" \t:#.- ")
        if rest:
            out.append(rest)
        if right:
            out += [q.text for q in page[i + 1 : i + 2] if q.band == p.band and q.x > p.end_x]
        if below:
            under = (q for q in page if p.band < q.band <= p.band + LINES_BELOW and q.x < p.end_x + COLUMN_REACH and q.end_x > p.x - COLUMN_REACH)
            out += [q.text for q in under][:1]
    return out


def offered(pages: list[list[Phrase]], learned: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """For each field the texts to be tried, in order. Totals: the most telling label first, of these the last page and the
    last place first; other fields from the first page that has one. Learnt labels come after all usual ones."""
    learned = learned or {}
    out: dict[str, list[str]] = {"total": []}
    for labels in TOTALS:
        for page in reversed(pages):
            out["total"] += behind(page, labels, OTHERWISE["total"], below=False)[::-1]
    for name, labels in LABELS.items():
        where = pages[:1] if name == "customer" else pages
        out[name] = [t for page in where for t in behind(page, labels, OTHERWISE.get(name, ()), right=name != "customer")]
    out["terms"] += [p.text for page in pages for p in page if any(w in f"{p.text.lower()} " for w in TERMS_ANYWHERE)]
    for name in ("total", "po"):
        out[name] += [t for label in learned.get(name, []) for page in pages for t in behind(page, [label])]
    return out


def as_po(c: Column) -> Column:
    """A purchase order as printed: short, a digit, three words at most, neither a date nor an amount; else null."""
    t = F.rtrim(F.trim(c), F.lit(".,;"))
    words = F.size(F.split(t, r"\s+"))
    good = F.length(t).between(2, 30) & t.rlike("[0-9]") & t.rlike("^[A-Za-z0-9][A-Za-z0-9 ./_#-]*$") & (words <= 3) & dates.parse_date(t).isNull() & ~t.rlike(r"[0-9][.,][0-9]{2}$")
    return F.when(good, t)


def as_name(c: Column) -> Column:
    """A customer's name: words that are no label; else null."""
    t = F.trim(c)
    label = F.lower(F.rtrim(t, F.lit(" :#."))).isin(*{x for labels in (*LABELS.values(), *TOTALS) for x in labels}, "invoice", "invoice number", "invoice no")
    return F.when(F.length(t).between(2, 80) & t.rlike(r"\p{L}{2}") & ~label, t)


OFFERED = "total array<string>, date array<string>, due array<string>, terms array<string>, po array<string>, customer array<string>"


def offers(text: Column, learned: dict[str, list[str]] | None = None, spans: Column | None = None) -> Column:
    """STRUCT of what is offered for each field by an invoice's text (pages cut at page breaks) or, with ``spans`` (an
    ARRAY of the spans of one page), by a page with a layout."""

    @F.pandas_udf(OFFERED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import json

        for texts, layouts in batches:
            rows = []
            for t, layout in zip(texts, layouts, strict=True):
                pages = [phrases(t or "", json.loads(layout))] if layout else [phrases(p) for p in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\f")]
                rows.append(offered(pages, learned))
            yield pd.DataFrame(rows, columns=["total", *LABELS])

    return run(text, F.to_json(spans) if spans is not None else F.lit(None).cast("string"))


def read_fields(docs: DataFrame, text: str = "text", learned: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds total, currency, issued, issued_ambiguous, due, days, eom, po, customer: the first offered text of each field that
    reads as one. ``due`` is the printed date, else worked out from the terms."""
    first = lambda name, read: F.try_element_at(F.filter(F.transform(F.col(f"_o.{name}"), read), lambda v: v.isNotNull()), F.lit(1))
    money_of = lambda t: F.when(money.parse_money(t).isNotNull(), F.struct(money.parse_money(t).alias("amount"), money.currency_of(t).alias("currency")))
    out = docs.withColumn("_o", offers(F.col(text), learned)).withColumn("_t", first("total", money_of))
    order = dates.date_order_for(F.col("_t.currency"))
    out = out.withColumn("_order", order)
    read_date = lambda t: dates.parse_date(t, F.col("_order"))
    out = out.withColumn("_d", first("date", read_date)).withColumn("_due", first("due", read_date)).withColumn("_n", first("terms", dates.parse_terms))
    worked_out = dates.due_date(F.col("_d.day"), F.col("_n.days"), F.col("_n.eom"))
    return (
        out.withColumn("total", F.col("_t.amount"))
        .withColumn("currency", F.col("_t.currency"))
        .withColumn("issued", F.col("_d.day"))
        .withColumn("issued_ambiguous", F.col("_d.ambiguous"))
        .withColumn("due", F.coalesce("_due.day", worked_out))
        .withColumn("days", F.col("_n.days"))
        .withColumn("eom", F.col("_n.eom"))
        .withColumn("po", first("po", as_po))
        .withColumn("customer", first("customer", as_name))
        .drop("_o", "_t", "_order", "_d", "_due", "_n")
    )


# ---- learning


def usable_label(text: str) -> str | None:
    """A label worth remembering: words of letters, short, without a digit."""
    label = text.strip().rstrip(":#.- \t").strip()
    return label if 2 <= len(label) <= 40 and re.search(r"[^\W\d_]{2}", label) and not re.search("[0-9]", label) else None


def plain(text: str) -> str:
    return re.sub("[^a-z0-9]", "", (text or "").lower())


def holds(text: str, typed: str, amount: bool) -> bool:
    """Whether a text holds what a person typed, written perhaps with other marks."""
    if not amount:
        return bool(plain(typed)) and plain(typed) in plain(text)
    digits = lambda s: re.sub("[^0-9]", "", re.sub(r"([.,])([0-9])$", r"\1\g<2>0", s))
    return bool(digits(typed)) and any(digits(n) == digits(typed) for n in re.findall(r"[0-9][0-9.,'  ]*", text))


def labels_around(page: list[Phrase], p: Phrase, typed: str) -> list[str]:
    """Texts that may be the label of a value in a phrase: before it, to its left, above it."""
    at = p.text.lower().find(typed.strip().lower())
    if at < 0:
        run = max(re.findall("[0-9]+", typed), key=len, default="")
        at = max(0, p.text.find(run)) if run else 0
    before = re.sub(r"(?i)p\.?\s?o\.?[\s#-]*$", "", p.text[:at])
    left = max((q for q in page if q.band == p.band and q.end_x <= p.x + 1 and q is not p), key=lambda q: q.end_x, default=None)
    over = [q for q in page if p.band - LINES_BELOW <= q.band < p.band and q.x < p.end_x + COLUMN_REACH and q.end_x > p.x - COLUMN_REACH]
    above = max(over, key=lambda q: q.band, default=None)
    return [label for t in (before, left.text if left else "", above.text if above else "") if (label := usable_label(t))]


def learn_label(text: Column, field: str, typed: Column, never: Column | None = None) -> Column:
    """The label to remember for a value (``po`` or ``total``) that a person typed for an invoice: one beside the value that
    leads back to it on the same pages; null without one. ``never``: ARRAY<STRING> of texts that are no label."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, values, nots in batches:
            yield pd.Series([_learnt(t or "", v or "", {plain(x) for x in (n if n is not None else [])}, field == "total") for t, v, n in zip(texts, values, nots, strict=True)], dtype=object)

    return run(text, typed, never if never is not None else F.lit(None).cast("array<string>"))


def _learnt(text: str, typed: str, never: set[str], amount: bool) -> str | None:
    if not typed.strip():
        return None
    pages = [phrases(p) for p in text.replace("\r\n", "\n").split("\f")]
    for page in pages:
        for p in page:
            if holds(p.text, typed, amount):
                for label in labels_around(page, p, typed):
                    if plain(label) not in never and any(holds(t, typed, amount) for other in pages for t in behind(other, [label])[:1]):
                        return label
    return None


def po_pattern(po: Column) -> Column:
    """The shape of an order as a pattern: letters as they are, runs of digits by their number, blanks that may be missing;
    null without a digit."""
    runs = F.regexp_extract_all(F.upper(F.trim(po)), F.lit(r"[A-Z]+|[0-9]+|\s+|[^A-Z0-9\s]"), 0)
    one = lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("[0-9]{"), F.length(r).cast("string"), F.lit("}"))).when(r.rlike(r"^\s"), F.lit(r"\s?")).when(r.rlike("^[A-Z]"), r).otherwise(F.concat(F.lit(r"\Q"), r, F.lit(r"\E")))
    return F.when(po.rlike("[0-9]"), F.array_join(F.transform(runs, one), ""))


def describe_pattern(po: Column) -> Column:
    """The shape of an order as a person reads it: 'BR-####'."""
    return F.regexp_replace(F.upper(F.trim(po)), "[0-9]", "#")


def find_by_pattern(text: Column, pattern: Column, never: Column | None = None) -> Column:
    """The one value of a text that has a pattern, by its key; null when there is none or more than one."""
    whole = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])("), pattern, F.lit(r")(?![A-Za-z0-9])"))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), whole, F.lit(1))
    if never is not None:
        found = F.filter(found, lambda v: po_key(v) != po_key(F.coalesce(never, F.lit(""))))
    return F.when(F.size(F.array_distinct(F.transform(found, po_key))) == 1, found[0])
