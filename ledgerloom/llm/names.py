"""Variant spellings of names typed by people, linked to the firm or person they mean.

Distinct strings are parsed into a *form*: legal form off, words of trade resolved (also abbreviated), the rest as stems; a
person's given name through a nickname table. Forms are blocked by phonetic codes of their tokens (the whole code of one,
half the code of another, so that one slip of the pen leaves a block in common), compared by Jaro-Winkler plus the nickname
table with an exact one-edit check behind it, and accepted pairs are clustered by connected components. Forms that leave out
what tells two firms or persons apart (no trade, an ambiguous abbreviation, an initial) join a cluster only when all their
matches lie in one. Words of trade are those of a table and those learnt from the corpus by the words they stand beside.

Hot names cost nothing: rows are distinct strings before anything else, and strings of one form are one node. A block is cut
into chunks of CHUNK forms; each meeting of two chunks is a row of its own, shuffled by the two, so no task grows with a block. Defined results: null, blank and
placeholder strings name nobody; an empty table gives an empty table; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.runtime import join_counted, materialise

CHUNK = 128
#: Least Jaro-Winkler similarity of two stems before the exact check; one slip among letters that repeat can bring it to 0.8.
LEAST_SIMILAR = 0.78
#: A word is one of trade where it stands beside so many different words: this share of the distinct strings, this many at least.
TRADE_SHARE, TRADE_LEAST = 1 / 200, 9

# Strings that name nobody.
PLACEHOLDERS = frozenset("na none null nil unknown tbc tba tbd various misc nn xxx x ohne sin desconocido inconnu unbekannt".split())
# Words of legal forms, folded.
LEGAL = frozenset(
    "co company corp corporation plc ltd limited llc llp inc incorporated gmbh mbh gesellschaft kg ohg ug ag aktiengesellschaft se bv nv sas sarl sa sasu sl slu srl spa snc sp spolka z oo et fils sociedad limitada anonima oy ab as aps".split()
)
# Words of trade, folded, in the languages of the data.
TRADES = (
    "electrical foods office supplies management textiles services printing brothers technologies logistics international manufacturing "
    "construction timber engineering associates chemicals plumbing heating catering equipment hire "
    "druckerei werkzeugbau maschinenbau gebaudetechnik grosshandel spedition mobelhaus "
    "transports imprimerie materiaux traiteur electricite menuiserie "
    "vervoer techniek groothandel drukkerij imprenta suministros logistica construccion alimentacion "
    "trasporti forniture tipografia elettronica hurtownia uslugi drukarnia"
).split()
# Trades of two words, written as one token after parsing.
TRADE_PAIRS = {("office", "supplies"): "officesupplies", ("plumbing", "heating"): "plumbingheating", ("equipment", "hire"): "equipmenthire"}
# Abbreviations that keep no prefix.
TRADE_SHORT = {"intl": "international", "mfg": "manufacturing", "mgmt": "management", "svcs": "services", "bros": "brothers", "fds": "foods", "prtg": "printing", "tmbr": "timber", "eqpt": "equipment", "werkzb": "werkzeugbau"}
FILLERS = frozenset("of and und the y e i en".split())
# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sandy sascha xander lex", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji", "catherine": "cathy kate katie cat", "charles": "charlie chuck chas chip",
    "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby debra", "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth lizzie betty eliza lisa bess libby betsy", "francisco": "paco pancho fran kiko curro",
    "friedrich": "fritz fred friedel", "gabriela": "gabi gaby gabriella", "giovanni": "gianni vanni nino", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "johannes": "hannes hans jo johann", "joseph": "joe joey jos",
    "katherine": "kate katie kathy kat kathryn kitty", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge greta", "michael": "mike mick mickey micky", "nicholas": "nick nicky nico", "patricia": "pat patty tricia trish patti",
    "rebecca": "becky becca beck", "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie bert", "stephanie": "steffi steph fanny stef", "susan": "sue susie suzy suzie", "thomas": "tom tommy", "victoria": "vicky vicki tori vic",
    "william": "bill will billy willy liam", "zdzislawa": "zdzisia dzidka slawa zdzicha", "matthew": "matt matty", "samuel": "sam sammy", "timothy": "tim timmy", "jose": "pepe", "ignacio": "nacho", "giuseppe": "beppe peppe pino", "david": "dave davey",
    "aleksandr": "sasha sanya alex", "dmitri": "dima mitya", "mikhail": "misha", "nikolai": "kolya", "ekaterina": "katya", "anna": "anya annie", "tatiana": "tanya", "vladimir": "vova volodya", "natalia": "natasha", "elena": "lena", "ivan": "vanya",
    "jonathan": "jon jonny", "nathaniel": "nate nat", "joshua": "josh", "jacob": "jake", "gerald": "gerry jerry", "raymond": "ray", "walter": "walt wally", "arthur": "art", "albert": "al bert", "eleanor": "ellie nell nora", "harriet": "hattie", "henry": "harry hank",
    "judith": "judy", "oliver": "ollie", "pamela": "pam", "philip": "phil", "sarah": "sally", "sophia": "sophie", "valerie": "val", "vincent": "vince vinny", "zachary": "zach zack", "peter": "pete", "barbara": "barb babs", "dorothy": "dot dotty", "frederick": "fred freddy", "gregory": "greg", "jeffrey": "jeff", "kenneth": "ken kenny", "lawrence": "larry", "ronald": "ron ronnie", "stephen": "steve", "theodore": "theo",
    "wilhelm": "willi", "heinrich": "heinz heiner", "malgorzata": "gosia", "katarzyna": "kasia", "aleksandra": "ola", "guillermo": "memo", "eduardo": "lalo edu", "isabel": "isa", "maria": "mia", "antonio": "toni", "luigi": "gigi", "philippe": "phil",
}
FORMAL: dict[str, frozenset[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _n in (_full, *_shorts.split()):
        FORMAL[_n] = FORMAL.get(_n, frozenset()) | {_full}

_LETTERS = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "`": "'"})


def fold(s: str) -> str:
    """Lower case, without accents."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).lower().translate(_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours (or none) turns ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    t = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


def similar(a: str, b: str, loose: bool = False) -> bool:
    """Jaro-Winkler first; then one slip at most, two in very long tokens, or in long ones if ``loose``."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or jaro_winkler(a, b) < LEAST_SIMILAR:
        return False
    if one_edit(a, b):
        return True
    return min(len(a), len(b)) >= (6 if loose else 14) and two_edits(a, b)


def two_edits(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    return one_edit(a[1:], b) or one_edit(a, b[1:]) or one_edit(a[1:], b[1:]) or (a[:2] == b[:2][::-1] and one_edit(a[2:], b[2:]))


_CODE = str.maketrans({"z": "s", "c": "k", "q": "k", "w": "v", "f": "v", "b": "p", "d": "t", "g": "k", "j": "y", "m": "n"} | dict.fromkeys("aeiouyh", None))


@lru_cache(100_000)
def phonetic(token: str) -> str:
    """Consonants by sound, vowels left out, neighbours alike once."""
    return re.sub(r"(.)\1+", r"\1", token.translate(_CODE)) or token[:1]


def _abbreviates(token: str, trade: str) -> bool:
    """Whether a token is a word's first letter with some of its consonants, the last one among them (mgmt, svcs)."""
    if not (len(token) >= 3 and len(trade) > len(token) and token[0] == trade[0] and token[-1] == trade[-1] and not set(token[1:]) & set("aeiouy")):
        return False
    rest = iter(trade)
    return all(c in rest for c in token)


@lru_cache(50_000)
def trade_of(token: str, dotted: bool, learnt: frozenset[str] = frozenset()) -> frozenset[str]:
    """The words of trade a token can stand for; ``learnt``: words of the corpus besides those known."""
    trades = (*TRADES, *sorted(learnt))
    if token in trades:
        return frozenset([token])
    if token in TRADE_SHORT:
        return frozenset([TRADE_SHORT[token]])
    if len(token) >= 6:
        near = frozenset(t for t in trades if one_edit(token, t))
        if near:
            return near
        squeezed = re.sub(r"(.)\1+", r"\1", token)
        near = frozenset(t for t in trades if re.sub(r"(.)\1+", r"\1", t) == squeezed)
        if near:
            return near
    if dotted and len(token) >= 3 or len(token) == 4 and token in ("tech", "elec"):
        return frozenset(t for t in trades if len(t) > len(token) and t.startswith(token))
    return frozenset(t for t in trades if _abbreviates(token, t))


def words(name: str) -> set[str]:
    """The words of a name that can be stems or trades."""
    return {t for t in re.findall(r"[^\W\d_]+", fold(name)) if len(t) > 3 and t not in LEGAL and t not in FILLERS}


def learn_trades(names: DataFrame) -> frozenset[str]:
    """Words of trade that the table lacks: those that stand beside TRADE_SHARE of all distinct strings in different words.

    A string has few words, so few words can have such a share: the result is bounded (by the words of a string over
    TRADE_SHARE), whatever the corpus. Given names, and what a known trade is written like, aren't learnt.
    """

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, v) for n in batch.column(0).to_pylist() for own in [words(n)] for w in own for v in own if w != v]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], names=["word", "other"])

    total = names.count()
    least = max(TRADE_LEAST, int(total * TRADE_SHARE))
    often = names.mapInArrow(beside, "word string, other string").distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = sorted(r["word"] for r in often.select("word").collect())
    fresh = [w for w in found if w not in FORMAL and not trade_of(w, True)]
    # of words that abbreviate one another the long ones stand
    return frozenset(w for w in fresh if not any(v != w and (v.startswith(w) or _abbreviates(w, v)) for v in fresh))


Form = tuple[str, tuple[str, ...], tuple[str, ...], tuple[bool, ...]]  # kind, trades or given names, stems, which are cut off


def parse(name: str | None, learnt: frozenset[str] = frozenset()) -> Form | None:
    """The form of a name: ("firm", trades, stems, cut) or ("person", formal given names or "x." or a word, (family,), ...)."""
    if name is None:
        return None
    text = fold(name)
    text = re.sub(r"\b([a-z])\.\s?(?=[a-z]\b\.?)", r"\1", text) if re.search(r"\b[a-z]\.\s?[a-z]\b\.", text) else text
    text = re.sub(r"\bp\s*&\s*h\b", "plumbing heating", text)
    text = re.sub(r"\bmasch\.\s*bau\b", "maschinenbau", re.sub(r"\bgeb\.\s*-?\s*technik\b", "gebaudetechnik", text))
    raw = re.findall(r"([^\W_]+)(\.?)", text)
    if not raw or "".join(t for t, _ in raw) in PLACEHOLDERS:
        return None
    inverted = bool(re.match(r"^\s*[^\W_]+\s*[,(]", text))
    tokens = [(t, bool(d)) for t, d in raw if t not in FILLERS or (len(t) == 1 and (d or len(raw) == 2))]
    legal = [t for t, _ in tokens if t in LEGAL]
    tokens = [x for x in tokens if x[0] not in LEGAL] or tokens
    if not legal and len(tokens) == 2:
        person = _person(tokens, inverted)
        if person:
            return person
    trades: list[frozenset[str]] = []
    stems: list[tuple[str, bool]] = []
    for i, (t, d) in enumerate(tokens):
        last = d and i == len(tokens) - 1 and not legal and len(t) > 5  # a full stop at the very end is no abbreviation
        found = trade_of(t, d and not last, learnt)
        if found and not (d and len(t) == 3 and len(tokens) == 2 and not found):
            trades.append(found)
        else:
            stems.append((t, d and not last))
    if len(stems) > 2 and not trades:  # abbreviations without a full stop
        short = [x for x in stems if len(x[0]) >= 3 and trade_of(x[0], True, learnt)]
        trades, stems = [trade_of(t, True, learnt) for t, _ in short], [x for x in stems if x not in short]
    if not stems:
        stems, trades = [(t, d) for t, d in tokens], []
    stems.sort()
    return ("firm", tuple(_trade_sets(trades)), tuple(t for t, _ in stems), tuple(d for _, d in stems))


def _trade_sets(found: list[frozenset[str]]) -> list[str]:
    """Possible trades, two-word ones joined; either word is enough to know the pair."""
    words = frozenset().union(*found) if found else frozenset()
    joined = {p for (a, b), p in TRADE_PAIRS.items() if a in words or b in words}
    plain = {w for w in words if not any(w in pair for pair in TRADE_PAIRS)}
    exact = [f for f in found if len(f) == 1]
    if joined and not (plain and exact and next(iter(exact[0])) in plain):
        return sorted(joined) if len(found) > 1 or not plain else sorted(joined | plain)
    return sorted(plain | joined)


def _person(tokens: list[tuple[str, bool]], inverted: bool) -> Form | None:
    (a, da), (b, db) = tokens
    for (given, dotted), (family, _) in (((b, db), (a, da)), ((a, da), (b, db))) if inverted else (((a, da), (b, db)), ((b, db), (a, da))):
        if len(family) < 3:
            continue
        if given in FORMAL:
            return ("person", tuple(sorted(FORMAL[given])), (family,), (False,))
        if len(given) == 1:
            return ("person", (given + ".",), (family,), (False,))
        if dotted and len(given) >= 3:
            known = sorted(f for f in NICKNAMES if f.startswith(given))
            if known:
                return ("person", tuple(known), (family,), (False,))
    for given, family in ((b, a), (a, b)) if inverted else ((a, b), (b, a)):
        if len(given) >= 3 and len(family) >= 3:
            known = sorted({f for n, fs in FORMAL.items() if len(n) >= 3 and len(given) >= 4 and one_edit(given, n) for f in fs})
            if known:
                return ("person", tuple(known), (family,), (False,))
    return None


def weakness(form: Form) -> int:
    """0: a form that tells namesakes apart; 1: two whole words without a trade, a firm that leaves its trade out or a person
    whose given name isn't in the table; 2: an initial, words cut off, more than one trade or given name possible."""
    if len(form[1]) == 1 and not form[1][0].endswith(".") and not any(form[3]):
        return 0
    return 1 if form[0] == "firm" and not form[1] and len(form[2]) == 2 and not any(form[3]) else 2


def _halves(code: str) -> tuple[str, str]:
    return "<" + code[:2], ">" + code[-2:]


def block_keys(form: Form) -> list[str]:
    """Blocks of a form: the phonetic code of one token with half the code of the other."""
    kind, first, stems, cut = form
    if kind == "person":
        family = phonetic(stems[0])
        names = {g[:1] for g in first}
        halves = (*_halves(family), stems[0][0] + "-" + stems[0][-1])
        initial = {f"p|{h}|{g}" for g in first if g.endswith(".") for h in (family, *halves[:2])}
        return sorted({f"p|{family}|{g}" for g in names} | {f"p|{h}|{g}" for g in first if not g.endswith(".") for h in halves} | initial)
    keys = set()
    codes = [phonetic(s) for s in stems]
    if len(stems) == 2:
        for x, y in ((0, 1), (1, 0)):
            if not cut[x]:
                head, tail = _halves(codes[y])
                keys |= {f"f|{codes[x]}|{head}", f"f|{codes[x]}|{head[:2]}"} | ({f"f|{codes[x]}|{tail}"} if not cut[y] else set())
                keys |= {f"c|{c}|{h}" for c in ("<" + codes[x][:3], ">" + codes[x][-3:]) for h in (head, head[:2])}  # a slip in one, the other cut off
                keys.add(f"i|{codes[x]}|{stems[y][0]}")  # a slip in what is left of the other
        whole = [codes[0] + codes[1], codes[1] + codes[0]] if not any(cut) else []
        if len(first) == 1:  # a slip in either token leaves half of each; within one trade that is few enough
            keys |= {f"h|{first[0]}|{'|'.join(sorted((x, y)))}" for x in _halves(codes[0]) for y in _halves(codes[1])}
            keys.add(f"b|{first[0]}|{'|'.join(sorted(s[:2] for s in stems))}")
        if not first and not any(cut):  # it may be a person: met by an initial and a family name
            for given, family in ((0, 1), (1, 0)):
                keys |= {f"p|{codes[family]}|{stems[given][0]}.", *(f"p|{h}|{stems[given][0]}." for h in _halves(codes[family]))}
    else:
        whole = ["".join(codes)]
    for w in whole:
        w = re.sub(r"(.)\1+", r"\1", w)
        keys |= {f"w|<{w[:5]}|{min(len(w), 6)}", f"w|>{w[-5:]}|{min(len(w), 6)}"}
    return sorted(keys)


def same(a: Form, b: Form, loose: bool = False) -> bool:
    """Whether two forms can name the same firm or person. ``loose``: where other evidence (one invoice number) joins them,
    either side may have a slip in the same word."""
    if a[0] != b[0]:
        person, firm = (a, b) if a[0] == "person" else (b, a)
        return _initial_fits(person, firm, loose)
    if a[0] == "person":
        if not similar(a[2][0], b[2][0], loose):
            return False
        x, y = set(a[1]), set(b[1])
        if x & y:
            return True
        return any(g.endswith(".") and any(h.startswith(g[0]) for h in other) for mine, other in ((x, y), (y, x)) for g in mine)
    if a[1] and b[1] and not set(a[1]) & set(b[1]):
        return False
    return _stems_match(a, b, loose)


def _initial_fits(person: Form, firm: Form, loose: bool) -> bool:
    """Whether an initial and a family name can be two whole words without a trade."""
    if firm[1] or len(firm[2]) != 2 or any(firm[3]) or not all(g.endswith(".") for g in person[1]):
        return False
    return any(given.startswith(g[0]) and similar(person[2][0], family, loose) for g in person[1] for given, family in (firm[2], firm[2][::-1]))


def _stems_match(a: Form, b: Form, loose: bool) -> bool:
    s, t = a[2], b[2]
    if len(s) == 2 and len(t) == 2:
        for i, j in ((0, 1), (1, 0)):
            if not loose and not (a[1] and b[1]) and s[0] != t[i] and s[1] != t[j]:
                continue  # without its trade a name needs one word that is exactly the other's
            if _stem(s[0], a[3][0], t[i], b[3][i], loose) and _stem(s[1], a[3][1], t[j], b[3][j], loose):
                return True
        return False
    if len(s) == len(t) == 1:
        return _stem(s[0], a[3][0], t[0], b[3][0], loose)
    joins = lambda x: {"".join(x), "".join(reversed(x))}
    return any(similar(x, y, loose) for x in joins(s) for y in joins(t))


def _stem(x: str, x_cut: bool, y: str, y_cut: bool, loose: bool) -> bool:
    if similar(x, y, loose):
        return True
    if x_cut and len(x) >= 3 and len(y) > len(x):
        return y.startswith(x) or (len(x) >= 4 and one_edit(x, y[: len(x)]))
    return y_cut and len(y) >= 3 and len(x) > len(y) and (x.startswith(y) or (len(y) >= 4 and one_edit(y, x[: len(y)])))


def encode_form(form: Form) -> str:
    return "|".join((form[0], ",".join(form[1]), ",".join(form[2]), ",".join("1" if c else "0" for c in form[3])))


@lru_cache(200_000)
def decode_form(s: str) -> Form:
    kind, first, stems, cut = s.split("|")
    return kind, tuple(x for x in first.split(",") if x), tuple(stems.split(",")), tuple(c == "1" for c in cut.split(","))


def forms(names: DataFrame, learnt: frozenset[str] = frozenset()) -> DataFrame:
    """(name, form, weak, keys) of distinct strings that name somebody."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("form", pa.string()), ("weak", pa.int32()), ("keys", pa.list_(pa.string()))])
        for batch in batches:
            rows = [(n, f) for n in batch.column(0).to_pylist() if (f := parse(n, learnt))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([encode_form(f) for _, f in rows], pa.string()), pa.array([weakness(f) for _, f in rows], pa.int32()), pa.array([block_keys(f) for _, f in rows], pa.list_(pa.string()))], schema=schema)

    return names.mapInArrow(run, "name string, form string, weak int, keys array<string>")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = set()
        for left, right, within in zip(batch.column("l").to_pylist(), batch.column("r").to_pylist(), batch.column("within").to_pylist(), strict=True):
            for i, x in enumerate(left):
                a = decode_form(x)
                for y in left[i + 1 :] if within else right:
                    if same(a, decode_form(y)):
                        pairs.add((x, y) if x < y else (y, x))
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def meetings(parsed: DataFrame) -> DataFrame:
    """(l, r, within): chunks of each block, to be compared within themselves or with one another, one row per meeting."""
    blocks = parsed.select("form", F.explode("keys").alias("key")).distinct()
    sizes = materialise(blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    sized = join_counted(blocks, sizes, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    chunks = sized.groupBy("key", "chunks", F.pmod(F.xxhash64("form"), F.col("chunks")).alias("c")).agg(F.array_sort(F.collect_list("form")).alias("f"))
    chunks = materialise(chunks, "chunks")
    within = chunks.select(F.col("f").alias("l"), F.array().cast("array<string>").alias("r"), F.lit(True).alias("within"))
    many = chunks.where("chunks > 1")
    if many.isEmpty():
        return within
    # each chunk goes to its meeting with every other one of its block; meetings are few bytes and much work, so their number
    # of tasks is given
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda d: d != F.col("c"))
    sent = many.select("key", "c", "f", F.explode(others).alias("d"))
    tasks = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.withColumn("lo", F.least("c", "d")).withColumn("hi", F.greatest("c", "d")).repartition(tasks, "key", "lo", "hi").groupBy("key", "lo", "hi")
    across = met.agg(F.max(F.when(F.col("c") < F.col("d"), F.col("f"))).alias("l"), F.max(F.when(F.col("c") > F.col("d"), F.col("f"))).alias("r"))
    across = across.where("l IS NOT NULL AND r IS NOT NULL").select("l", "r", F.lit(False).alias("within"))
    return within.unionByName(across)


def matches(parsed: DataFrame) -> DataFrame:
    """(a, b): pairs of forms that match, found within blocks."""
    return meetings(parsed).mapInArrow(_compare, "a string, b string").distinct()


def link(names: DataFrame) -> DataFrame:
    """(name, entity): strings with the same entity name the same firm or person. ``names`` has one string column.

    Forms that tell namesakes apart (weakness 0) are clustered. Then those of weakness 1, then of 2, each join the one cluster
    that all their matches of the least weakness lie in; one whose matches lie in several joins none; those that match no
    stronger form are clustered among themselves.
    """
    column = names.columns[0]
    names = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    parsed = materialise(forms(names, learn_trades(names)), "forms")
    edges = materialise(matches(parsed), "matches")
    nodes = materialise(parsed.groupBy("form").agg(F.max("weak").alias("weak")), "nodes")
    tagged = edges.join(nodes.select(F.col("form").alias("a"), F.col("weak").alias("wa")), "a").join(nodes.select(F.col("form").alias("b"), F.col("weak").alias("wb")), "b")
    tagged = materialise(tagged, "edges")
    strong = connected_components(tagged.where("wa = 0 AND wb = 0").select("a", "b"))
    entity = nodes.where("weak = 0").join(strong.withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("component", "form").alias("entity"), F.lit(0).alias("level"))
    entity = materialise(entity, "level")
    for level in (1, 2):
        own = nodes.where(F.col("weak") == level).select("form")
        up = tagged.where((F.col("wa") == level) & (F.col("wb") < level)).select(F.col("a").alias("form"), F.col("b").alias("to"))
        down = tagged.where((F.col("wb") == level) & (F.col("wa") < level)).select(F.col("b").alias("form"), F.col("a").alias("to"))
        reach = up.unionByName(down).join(entity.withColumnRenamed("form", "to"), "to")
        ends = reach.groupBy("form", "level").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
        ends = materialise(ends.groupBy("form").agg(F.min_by(F.struct("lo", "hi"), "level").alias("e")).select("form", "e.*"), "reach")
        alone = own.join(ends.select("form"), "form", "left_anti")
        among = tagged.where((F.col("wa") == level) & (F.col("wb") == level)).select("a", "b").join(alone.withColumnRenamed("form", "a"), "a", "left_semi").join(alone.withColumnRenamed("form", "b"), "b", "left_semi")
        left = alone.join(connected_components(among).withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("component", "form").alias("entity"))
        joined = ends.select("form", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("form")).alias("entity"))
        entity = materialise(entity.unionByName(joined.unionByName(left).withColumn("level", F.lit(level))), "level")
    return parsed.select("name", "form").join(entity, "form").select("name", "entity")


def pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), a before b in byte order, of each entity. Entities are dealt over tasks by parts of their spellings,
    so that a task makes the pairs of two parts, not of an entity."""
    sized = linked.join(linked.groupBy("entity").agg(F.ceil(F.count("*") / CHUNK).alias("parts")), "entity")
    placed = sized.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = placed.select("entity", F.col("part").alias("p"), F.col("other").alias("q"), F.col("name").alias("name_a"))
    right = placed.select("entity", F.col("other").alias("p"), F.col("part").alias("q"), F.col("name").alias("name_b"))
    return left.join(right, ["entity", "p", "q"]).where("name_a < name_b").select("name_a", "name_b")
