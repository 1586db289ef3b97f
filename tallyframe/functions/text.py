"""Column functions on text: tickers, amounts, names, symbols and classes. All are built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Written forms of a missing ticker.
NO_TICKER = ("--", "-", "N/A", "NA", "NONE", "NULL", "UNKNOWN")
# Words that look like tickers.
TICKER_WORDS = ("INC", "LLC", "LTD", "CO", "CORP", "ETF", "ADR", "NEW", "THE", "AND", "FOR", "USD", "CAD", "NYSE", "NASDAQ")
# Suffix of a listing, its currency and exchange.
LISTINGS = ((".TO", "CAD", "TSX"), (".V", "CAD", "TSXV"), (".NE", "CAD", "NEO"), (".L", "GBP", "LSE"), (".PA", "EUR", "Paris"), (".DE", "EUR", "Xetra"))
# Forms of address and of descent that are no part of a name.
HONORIFICS = "jr sr ii iii iv hon mr mrs ms dr".split()


def _plain_letters() -> tuple[str, str]:
    """Characters that decompose to one letter or digit, and those; then combining marks, which stand for nothing."""
    pairs, marks = [], [chr(i) for i in range(0x300, 0x370)]
    for i in range(0x80, 0x20000):
        if not 0xD800 <= i < 0xE000 and (d := unicodedata.normalize("NFKD", chr(i))) != chr(i):
            bare = "".join(c for c in d if c not in marks).lower()
            if len(bare) == 1 and bare.isascii() and bare.isalnum():
                pairs.append((chr(i), bare))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


ACCENTS = _plain_letters()
LEGAL_SUFFIXES = "inc incorporated corp corporation co company ltd limited plc llc lp sa nv ag the".split()
#: Asset class by description: the first rule that fits decides.
CLASS_RULES = (
    ("option", r"\b(call|put)s?\b.*\b(option|strike|exp)|\boption\b"), ("crypto", r"\b(bitcoin|ethereum|crypto)\b"), ("bond", r"\b(bond|note|treasury|debenture|muni)s?\b"),
    ("etf", r"\b(etf|ishares|spdr)\b"), ("fund", r"\b(fund|mutual)\b"), ("real_estate", r"\b(real estate|property|reit)\b"), ("cash", r"\b(cash|money market|deposit|checking)\b"),
    ("stock", r"\b(common|stock|shares|class [a-c])\b"),
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_ticker(raw: Column) -> Column:
    """Upper case without spaces, class marks as a dot; null where it is no ticker."""
    bare = F.regexp_replace(F.upper(F.trim(raw)), r"\s+", "")
    s = F.regexp_replace(bare, r"^([A-Z]{1,5})[/-]([A-Z])$", "$1.$2")
    return F.when(~bare.isin(*NO_TICKER) & ~s.isin(*TICKER_WORDS) & s.rlike(r"^[A-Z][A-Z0-9.]{0,11}$"), s)


def plain(text: Column) -> Column:
    """Lower case, plain letters, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, *ACCENTS)), r"[^a-z0-9]+", " "))


def fold(name: Column) -> Column:
    """A name in plain letters, without forms of address and descent."""
    bare = F.regexp_replace(F.lower(F.translate(name, *ACCENTS)), rf"(?<![a-z0-9_])({'|'.join(HONORIFICS)})(?![a-z0-9_])", " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def person_key(office: Column, last: Column, first: Column) -> Column:
    """Office, last name and first given name; what is empty is left out."""
    parts = F.array(office, plain(last), F.substring_index(plain(first), " ", 1))
    return F.array_join(F.filter(parts, lambda p: p != ""), ":")


def asset_stem(name: Column) -> Column:
    """Company name in plain letters without legal suffixes at its end."""
    return F.trim(F.regexp_replace(plain(F.regexp_replace(name, "&", " and ")), rf"( ({'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length; equal empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def asset_class(description: Column) -> Column:
    text = F.lower(description)
    return reduce(lambda c, r: c.when(text.rlike(r[1]), r[0]), CLASS_RULES, F.when(F.lit(False), F.lit(None).cast("string"))).otherwise("other")


def listing_currency(symbol: Column) -> Column:
    return reduce(lambda c, r: c.when(symbol.endswith(r[0]), r[1]), LISTINGS, F.when(F.lit(False), F.lit(None).cast("string"))).otherwise("USD")


def compact_dollars(x: Column) -> Column:
    """$950, $12.3K, $4.5M, $1.2B: of the number as it is written, halves away from zero."""
    v = F.abs(x.cast("decimal(38,12)"))
    unit = lambda d, s: F.concat(F.lit("$"), F.round((v / F.lit(d).cast("decimal(12,0)")).cast("decimal(38,12)"), 1).cast("decimal(20,1)").cast("string"), F.lit(s))
    body = F.when(v >= 10**9, unit(10**9, "B")).when(v >= 10**6, unit(10**6, "M")).when(v >= 1000, unit(1000, "K")).otherwise(F.concat(F.lit("$"), F.round(v, 0).cast("long").cast("string")))
    return F.concat(F.when(x < 0, "-").otherwise(""), body)


def loose_date(text: Column) -> Column:
    """A date in one of several written forms; null if it is none or out of range."""
    # The marks between its parts leave one form that can fit: each that does not would cost an exception.
    read = lambda t: (
        F.when(t.contains(","), F.when(F.instr(t, " ") == 4, F.try_to_date(t, "MMM d, yyyy")).otherwise(F.try_to_date(t, "MMMM d, yyyy"))).when(t.contains("/"), F.try_to_date(t, "M/d/yyyy"))
        .when(t.contains("-"), F.try_to_date(t, "yyyy-MM-dd")).when(t.contains(" "), F.try_to_date(t, "d MMM yyyy")).when(F.length(t) >= 8, F.try_to_date(t, "yyyyMMdd"))
    )
    return once(once(F.trim(text), read), lambda d: F.when(F.year(d).between(1990, 2100), d))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
