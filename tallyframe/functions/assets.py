"""Names of assets as filings write them: stems that two spellings share, share classes, and what a description says of its kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import named
from .text import ACCENTS, once

# Words that stand for nothing at a name's end: legal forms and states.
TAIL_WORDS = (
    "inc incorporated corp corporation co company companies ltd limited llc plc lp llp nv sa ag se spa com new del de md mn pa fl ca wa oh tx ny nj va nc il ma ga mi wi mo az or ut "
    "tn ky la al ok ct ia ks ar ms sc ne nm wv id hi me nh ri mt nd sd ak wy dc usa wis the"
).split()
# Abbreviations and the word that each stands for.
ABBREVIATED = {
    "international": "intl", "holdings": "hldg hldgs holding", "corporation": "corp", "company": "co", "companies": "cos", "group": "grp", "technology": "tech", "technologies": "techs",
    "manufacturing": "mfg", "services": "svcs", "systems": "sys", "pharmaceuticals": "pharma pharms pharmaceutical", "financial": "finl", "national": "natl", "american": "amer",
    "communications": "commun communication", "entertainment": "entmt", "industries": "inds industry", "properties": "pptys property", "realty": "rlty", "trust": "tr", "management": "mgmt",
    "development": "dev",
}
# Suffixes that may be one letter wrong, and words that are no such suffix.
SUFFIXES, NO_SUFFIXES = ("inc", "corp", "ltd", "llc"), "core come copy code coin cord cold coal cook cool inch".split()
# Legal forms written letter by letter, in the order in which they are joined.
SPELLED = ("plc", "llc", "nv", "sa", "ag", "lp")
# Words that say what a share is, not whose: of funds, and of others.
FUND_NOISE, SHARE_NOISE = "etf fund trust shares share shs".split(), "common ordinary stock shares share shs".split()
MOST_TAILS, MOST_RECEIPTS = 8, 4
# Words before a share's class letter, any number of them.
CLASS_WORDS = ("class", "cl", "series")
_CLASS = rf"\b(?:(?:{'|'.join(CLASS_WORDS)}) )+([a-c])\b"


def is_traded_fund(text: Column) -> Column:
    return text.rlike(r"(?i)\betf\b|exchange[\s-]+traded")


def _is_tail(word: Column) -> Column:
    wrong = reduce(lambda c, s: c | (F.levenshtein(word, F.lit(s), 1) >= 0), SUFFIXES, F.lit(False))
    return word.isin(*TAIL_WORDS) | (F.length(word).between(3, 5) & ~word.isin(*NO_SUFFIXES) & wrong)


def _without_tail(words: Column) -> Column:
    """One word less where the last is a tail and another stands before it; an "and" before it goes with it."""
    last = F.element_at(words, -1)
    shorter = F.slice(words, F.lit(1), F.size(words) - 1)
    linked = F.coalesce(F.get(words, F.size(words) - 2) == "and", F.lit(False))
    return F.when((F.size(words) > 1) & _is_tail(last), F.when(linked, F.slice(words, F.lit(1), F.size(words) - 2)).otherwise(shorter)).otherwise(words)


def asset_name(raw: Column) -> Column:
    """(stem, share_class, etf, fund) of a written name. The stem is in plain letters with abbreviations written out, without
    depositary receipts, up to eight legal forms or states at its end (one letter may be wrong), and words for shares.
    """
    text = F.lower(F.translate(F.coalesce(raw, F.lit("")), *ACCENTS))
    return once(F.regexp_replace(F.regexp_replace(text, "&", " and "), "[’']", ""), _name_of)


def _name_of(text: Column) -> Column:
    etf, fund = is_traded_fund(text), text.rlike(r"\bfund\b")
    text = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    share_class = F.regexp_extract(text, _CLASS, 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(text, _CLASS, " "), " +", " "))
    text = F.regexp_replace(F.regexp_replace(text, "^the ", ""), r"\bu s\b", "us")
    words = F.transform(F.split(text, " "), lambda w: named(w, {short: whole for whole, shorts in ABBREVIATED.items() for short in shorts.split()}, w))
    text = F.regexp_replace(F.array_join(words, " "), rf"(?:(?: sponsored)? (?:adr|ads)){{1,{MOST_RECEIPTS}}}$", "")
    text = reduce(lambda t, s: F.regexp_replace(t, f" {' '.join(s)}$", f" {s}"), SPELLED, text)
    words = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_TAILS)), F.split(text, " "), lambda acc, _: _without_tail(acc))
    noise = F.when(etf | fund, F.array(*map(F.lit, FUND_NOISE))).otherwise(F.array(*map(F.lit, SHARE_NOISE)))
    stem = once(noise, lambda bare: F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(bare, w)), " "))
    return F.struct(stem.alias("stem"), share_class.alias("share_class"), etf.alias("etf"), fund.alias("fund"))


# ---- what a description says ----------------------------------------------------------------------------

# Words and phrases of each kind.
PRIVATE = ["private equity", "private fund", "private credit", "private investment", "hedge fund"]
DEBT = (
    "bond bonds note notes debenture debentures muni munis municipal municipals callable tbill tbills t-bill t-bills tnote tnotes t-note t-notes tbond tbonds t-bond t-bonds".split()
    + ["treasury bill", "treasury bills", "treasury security", "treasury securities"]
)
TREASURIES = ["us treasur", "u s treasur", "united states treasur"]
PREFERRED = ["warrant", "warrants", "pfd", "perp", "perpetual", "depositary share", "depositary shares", "preferred stock", "preferred shares", "preferred series"]
OPTIONS, COINS = ["call", "calls", "put", "puts", "option", "options"], ["bitcoin", "ethereum", "crypto"]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _says(text: Column, phrases: list[str]) -> Column:
    """Whether a text holds one of the phrases as whole words, in any case and spacing."""
    return text.rlike(rf"(?i)\b(?:{'|'.join(p.replace(' ', '[ ]+') for p in phrases)})\b")


def is_private_fund(text: Column) -> Column:
    return _says(text, PRIVATE)


def _has_due_date(text: Column) -> Column:
    """Whether the word due stands before a year, a date in figures, or a month and a day."""
    after = F.regexp_extract_all(text, F.lit(r"(?i)\bdue +(\S+(?: +\S+)?)"), F.lit(1))
    figures = lambda d: d.rlike(r"^[0-9]{4}") | d.rlike(r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2}")
    month = lambda d: F.lower(F.left(d, F.lit(3))).isin(*MONTHS) & d.rlike(r"^[A-Za-z]+[.]? +[0-9]")
    return F.exists(after, lambda d: figures(d) | month(d))


def is_debt(text: Column) -> Column:
    """Words for debt, treasuries, a due date, or a coupon; never a fund that is traded."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[.]", ""), " +", " ")
    treasury = reduce(lambda c, t: c | bare.startswith(t) | bare.contains(f" {t}"), TREASURIES, F.lit(False))
    coupon = text.rlike(r"\b[0-9]{1,2}([.][0-9]+)? *%")
    return ~is_traded_fund(text) & (_says(text, DEBT) | treasury | _has_due_date(text) | coupon)


def is_preferred(text: Column) -> Column:
    """Preferred shares, perpetuals, depositary shares and warrants; never a fund that is traded."""
    return ~is_traded_fund(text) & _says(text, PREFERRED)


def described_class(text: Column) -> Column:
    """other (private funds too), bond, option, crypto, etf or fund, the first that fits."""
    return (
        F.when(is_private_fund(text), "other").when(is_debt(text), "bond").when(_says(text, OPTIONS), "option")
        .when(_says(text, COINS), "crypto").when(is_traded_fund(text), "etf").when(_says(text, ["fund"]), "fund").otherwise("other")
    )


def never_matched(text: Column) -> Column:
    """Why a description has no ticker, whatever its name: debt, option, crypto, private or preferred; null where it may have one."""
    kind = described_class(text)
    reason = named(kind, {"bond": "debt", "option": "option", "crypto": "crypto"}, F.lit(None).cast("string"))
    return F.coalesce(reason, F.when(is_private_fund(text), "private"), F.when(is_preferred(text), "preferred"))
