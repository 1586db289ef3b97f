"""Queries on names of assets. Every part has a made-up company; the SQL states what each written name stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import assets
from ..operators import names
from ..sources.kept import spread
from ..sources.tables import Tables
from .registry import query

#: A word of 16 letters that no other part has, in SQL of both engines, and the start of its tickers.
BASE = "translate(substring(md5(cast(p_partkey as varchar(20))), 1, 16), '0123456789', 'ghijklmnop')"
TICKER = "concat('T', upper(translate(cast(p_partkey as varchar(20)), '0123456789', 'abcdefghij')))"

#: A written name ({B}: the part's word) and its stem.
STEMS = [
    ("The {B} Intl Hldgs & Co., Inc.", "{B} international holdings"), ("{B} Tech Cl A", "{B} technology"), ("{B} N.V. Sponsored ADR", "{B}"), ("{B} Pharma plc Ordinary Shares", "{B} pharmaceuticals plc"),
    ("{B} Incc New Del", "{B}"), ("{B} Core", "{B} core"), ("{B} Growth Fund Trust", "{B} growth"), ("É{B} U.S. Mgmt Corp. Common Stock", "e{B} us management corporation"), ("{B} & Company The Wis", "{B}"),
    ("{B}’s Cos", "{B}s"), ("{B} P.L.C.", "{B}"), ("{B} Class Series B Holdings L L C", "{B} holdings"), ("Exchange-Traded {B} shares", "exchange traded {B}"),
]


def written(pairs: list[str], key: str = "p_partkey") -> str:
    """One of the texts by a key, with the part's word put in, as SQL of both engines."""
    cases = " ".join(f"when {n} then '{p.replace(chr(39), chr(39) * 2)}'" for n, p in enumerate(pairs))
    return f"replace(case cast({key} % {len(pairs)} as int) {cases} end, '{{B}}', {BASE})"


@query("str07_asset_name", f"select p_partkey, {written([s for _, s in STEMS])} as stem, case cast(p_partkey % {len(STEMS)} as int) when 1 then 'a' when 11 then 'b' else '' end as share_class, p_partkey % {len(STEMS)} = 12 as etf, p_partkey % {len(STEMS)} = 6 as fund from part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", assets.asset_name(F.expr(written([n for n, _ in STEMS]))).alias("n")).select("p_partkey", "n.*")


#: What a filing writes, and the class, stage, form, confidence and letters after the part's ticker that it comes to; null: no ticker.
NAMES: list[tuple[str, str, str, str | None, int | None, str | None]] = [
    ("The {B} Intl Hldgs, Inc.", "stock", "exact", "written", 100, ""), ("{B} International Holdings Incc", "stock", "exact", "written", 100, ""), ("{B}INC", "stock", "exact", "repaired", 100, ""),
    ("{B} Intl Holdings Class B", "stock", "exact", "written", 100, ".B"), ("{B} Intl Holdings Class C", "other", "none", None, None, None), ("{B} Intl Holdings 5.25% due 2030", "bond", "debt", None, None, None),
    ("{B} Holdings call option", "option", "option", None, None, None), ("{B} Internationa Holdings", "stock", "fuzzy", "written", 97, ""), ("{B} Holdings", "other", "none", None, None, None),
    ("{B} Holdings Corp", "stock", "exact", "written", 100, ""), ("{B} Holdings", "stock", "exact", "written", 100, ""), ("{B} Growth ETF", "etf", "curated", "written", 100, "E"),
    ("{B} Co", "stock", "alias", "written", 100, ""), ("{B} Co Series Q", "other", "preferred", None, None, None), ("{B} Holdings F", "stock", "exact", "foreign", 100, ""),
    ("{B} Trust REIT REIT", "stock", "exact", "reit", 100, ""), ("{B} private equity fund", "other", "private", None, None, None), ("{B} Holdings Pfd", "other", "preferred", None, None, None),
    ("{B} Holdings Class A", "stock", "exact", "written", 100, "L"), ("{B} Holdings bitcoin", "crypto", "crypto", None, None, None), ("{B} Holdings Series Q", "other", "preferred", None, None, None), ("  ", "other", "none", None, None, None),
]
#: What the exchanges list for it: names, letters after the ticker, exchanges.
LISTED: list[list[tuple[str, str, str]]] = [
    [("{B} International Holdings Corp", "", "NYSE")], [("{B} Intl Holdings", "", "Nasdaq")], [("{B} Inc", "", "NYSE")],
    [("{B} International Holdings", ".A", "NYSE"), ("{B} International Holdings", ".B", "NYSE")], [("{B} International Holdings", ".A", "NYSE"), ("{B} International Holdings", ".B", "NYSE")], [("{B} International Holdings", "", "NYSE")],
    [("{B} Holdings", "", "NYSE")], [("{B} International Holdings", "", "NYSE")], [("{B} Holdings", "A", "NYSE"), ("{B} Holdings Inc", "B", "NYSE")],
    [("{B} Holdings", "", "CBOE"), ("{B} Holdings", "Q", "OTC"), ("{B} Holdings", "P", "Toronto")], [("{B} Holdings", "", "NYSE"), ("{B} Holdings", "W", "NYSE"), ("{B} Holdings", "I", "NYSE")], [],
    [("{B} Worldwide Ventures", "", "NYSE")], [("{B} Worldwide Ventures", "", "NYSE")], [("{B} Holdings", "", "NYSE")],
    [("{B} Tr", "", "NYSE")], [("{B} private equity", "", "NYSE")], [("{B} Holdings", "", "NYSE")],
    [("{B} Holdings", "", "NYSE"), ("{B} Holdings", "L", "NYSE")], [("{B} Holdings", "", "NYSE")], [("{B} Holdings", "", "NYSE")], [("{B}", "", "NYSE")],
]


def _stock_list(t: Tables, pick: dict[int, list[tuple]], columns: list[str]) -> DataFrame:
    """Rows of a list for each part, by its key: columns of texts, in which {B} and {T} stand for the part's word and ticker."""
    of_key = lambda rs: F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, r))) for r in rs))
    lists = F.create_map(*(c for k, rs in pick.items() if rs for c in (F.lit(k), of_key(rs))))
    part = spread(t.part.select("p_partkey").where(F.expr(f"cast(p_partkey % {len(NAMES)} as int)").isin(*pick)))
    x = part.select(F.expr(BASE).alias("_b"), F.expr(TICKER).alias("_t"), F.explode(F.try_element_at(lists, F.expr(f"cast(p_partkey % {len(NAMES)} as int)"))).alias("r"))
    return x.select(*(F.replace(F.replace(F.col(f"r.{c}"), F.lit("{B}"), F.col("_b")), F.lit("{T}"), F.col("_t")).alias(c) for c in columns))


def entity_tables(t: Tables) -> dict[str, DataFrame]:
    catalog = _stock_list(t, {k: [(n, "{T}" + s, e) for n, s, e in rows] for k, rows in enumerate(LISTED)}, ["name", "ticker", "exchange"])
    curated = _stock_list(t, {11: [("{B} Growth ETF Trust", "{T}E", "etf")]}, ["name", "ticker", "class"])
    listings = _stock_list(t, {18: [("{B} Holdings", "a", "{T}L"), ("{B} Holdings", "c", "{T}")]}, ["name", "share_class", "ticker"])
    aliases = _stock_list(t, {12: [("{B} Co.", "{T}")], 13: [("{B} Co.", "{T}")], 20: [("{B} Holdings", "{T}")]}, ["name", "ticker"])
    return {"catalog": catalog, "curated": curated, "listings": listings, "aliases": aliases}


def _by_name(values: list, kind: str) -> str:
    quote = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"cast(case cast(p_partkey % {len(values)} as int) {' '.join(f'when {n} then {quote(v)}' for n, v in enumerate(values))} end as {kind})"


@query(
    "fin32_match_stages",
    f"""select p_partkey as id, {TICKER} || {_by_name([n[5] for n in NAMES], 'varchar')} as ticker, {_by_name([n[1] for n in NAMES], 'varchar')} as class, {_by_name([n[2] for n in NAMES], 'varchar')} as stage,
{_by_name([n[3] for n in NAMES], 'varchar')} as form, {_by_name([n[4] for n in NAMES], 'int')} as confidence from part""",
)
def _(t: Tables) -> DataFrame:
    """Every stage and form, each for a share of all parts."""
    wanted = spread(t.part.select("p_partkey")).select(F.col("p_partkey").alias("id"), F.expr(written([n[0] for n in NAMES])).alias("name"))
    return names.match_names(wanted, **entity_tables(t))


#: By part, what its stem's entries in the index are: share class and letters after the ticker.
INDEX = {0: [("", "")], 1: [("", "")], 2: [("", "")], 3: [("a", ".A"), ("b", ".B")], 4: [("a", ".A"), ("b", ".B")], 5: [("", "")], 6: [("", "")], 7: [("", "")], 9: [("", "")], 10: [("", "")], 12: [("", "")], 13: [("", "")], 14: [("", "")], 15: [("", "")], 16: [("", "")], 17: [("", "")], 19: [("", "")], 20: [("", "")], 21: [("", "")]}


@query("fin31_catalog_tickers", " union all ".join(f"select {TICKER} || '{s}' as ticker, '{c}' as share_class, 'stock' as class from part where p_partkey % {len(NAMES)} = {k}" for k, rows in INDEX.items() for c, s in rows))
def _(t: Tables) -> DataFrame:
    """One ticker a stem and class: best tier, none when-issued or of bonds, none of two common ones."""
    x = entity_tables(t)
    return names.catalog_index(x["catalog"], names.class_listings(x["listings"]))[0].select("ticker", "share_class", "class")


#: A description and its class; null reason: a name that may have a ticker.
DESCRIBED: list[tuple[str, str, str | None]] = [
    ("{B} ETF Note", "etf", None), ("{B} Municipal", "bond", "debt"), ("{B} 4.5% notes", "bond", "debt"), ("{B} due Sept 5, 2031", "bond", "debt"), ("U.S. Treasury {B}", "bond", "debt"), ("{B} T-Bills", "bond", "debt"),
    ("{B} puts", "option", "option"), ("{B} Bitcoin Trust", "crypto", "crypto"), ("{B} exchange traded", "etf", None), ("{B} Growth Fund", "fund", None), ("{B} hedge fund note", "other", "private"), ("{B} common", "other", None), ("{B} warrants", "other", "preferred"), ("{B} Treasury bill", "bond", "debt"),
]


@query("str23_described_class", f"select p_partkey, {_by_name([d[1] for d in DESCRIBED], 'varchar')} as class, {_by_name([d[2] for d in DESCRIBED], 'varchar')} as reason from part")
def _(t: Tables) -> DataFrame:
    text = F.expr(written([d[0] for d in DESCRIBED]))
    return t.part.select("p_partkey", assets.described_class(text).alias("class"), assets.never_matched(text).alias("reason"))
