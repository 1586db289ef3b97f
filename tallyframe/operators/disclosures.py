"""Disclosure analytics: rankings, nets over amount ranges, clusters, feeds and people.

Amounts are ranges: sums carry the lower bounds, the upper bounds (null when a range is open), how many rows are
open and how many have no readable range. All rankings are aggregates with map-side combine; a window runs
over groups, never over trades.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bound_of
from .ranks import numbered

MATCHABLE = ("stock", "etf", "fund")


def with_bounds(trades: DataFrame) -> DataFrame:
    """Adds low, high (null: open or unknown) and mid (the range's middle; an open range counts its lower bound)."""
    t = trades.withColumns({"low": bound_of(F.col("amount_range"), 1), "high": bound_of(F.col("amount_range"), 2)})
    return t.withColumn("mid", F.when(F.col("high").isNotNull(), (F.col("low") + F.col("high")) / F.lit(2.0)).otherwise(F.col("low").cast("double")))


def in_window(trades: DataFrame, as_of: str, days: int, column: str = "disclosed_date") -> DataFrame:
    """Rows of the last days, both ends included."""
    end = F.lit(as_of).cast("date")
    return trades.where(F.col(column).between(F.date_sub(end, days - 1), end))


def by_filer(status: str) -> Column:
    """'' takes all; 'candidate' only candidates; 'member' everyone who is not (a missing status counts as member)."""
    if status == "candidate":
        return F.col("filer_status") == "candidate"
    return ~F.col("filer_status").eqNullSafe("candidate") if status == "member" else F.lit(True)


def by_office(office: str) -> Column:
    offices = {"president": ("president", "vice-president")}.get(office, (office,))
    return F.col("office").isin(*offices) if office else F.lit(True)


def feed_filter(**asked: str | None) -> Column:
    """All given predicates at once; a blank one is left out."""
    tests = {
        "office": lambda v: by_office(v), "filer": lambda v: by_filer(v), "party": lambda v: F.col("party") == v, "tx_type": lambda v: F.col("tx_type") == v,
        "asset_class": lambda v: F.col("asset_class") == v, "since": lambda v: F.col("disclosed_date") >= v, "until": lambda v: F.col("disclosed_date") <= v,
        "ticker": lambda v: F.col("ticker") == v, "search": lambda v: F.lower(F.concat_ws(" ", "person_name", "ticker")).contains(v.lower()),
    }
    return reduce(lambda a, b: a & b, [tests[k](v) for k, v in asked.items() if v], F.lit(True))


def side_ranking(trades: DataFrame, top: int | None = 10) -> DataFrame:
    """The most traded tickers of each side."""
    t = with_bounds(trades.where(F.col("ticker").isNotNull() & F.col("tx_type").isin("buy", "sell")))
    g = t.groupBy("tx_type", "ticker").agg(
        F.count("*").alias("trades"), F.countDistinct("person_key").alias("people"), F.coalesce(F.sum("low"), F.lit(0)).alias("sum_low"), F.coalesce(F.sum("high"), F.lit(0)).alias("sum_high"),
        F.count_if(F.col("low").isNotNull() & F.col("high").isNull()).alias("open_rows"), F.count("low").alias("known"), F.bool_or(F.col("asset_class").isin(*MATCHABLE)).alias("matchable"),
    )
    order = [F.desc("trades"), F.desc("people"), F.col("ticker")]
    if top:
        # A limit in each task first, then over the few rows that are left; the count is an aggregate.
        ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("tx_type").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    else:
        return numbered(g, order, by=["tx_type"], total="side_tickers")
    return ranked.join(g.groupBy("tx_type").agg(F.count("*").alias("side_tickers")), "tx_type").select(*g.columns, "rank", "side_tickers")


def net_columns() -> list[Column]:
    side = lambda s: F.col("tx_type") == s
    known = F.col("low").isNotNull()
    return [
        F.count_if(side("buy")).alias("buys"), F.count_if(side("sell")).alias("sells"), F.count_if(side("buy") & known).alias("known_buys"), F.count_if(side("sell") & known).alias("known_sells"),
        F.sum(F.when(side("buy"), F.col("mid"))).alias("buy_mid"), F.sum(F.when(side("sell"), F.col("mid"))).alias("sell_mid"),
        F.count_if(known & F.col("high").isNull()).alias("open_rows"), F.count_if(~known).alias("excluded"),
    ]


def nets(trades: DataFrame, keys: list[str], both_sides: bool = True) -> DataFrame:
    """Net counts and estimated net dollars of groups; without any readable amount the estimate is null."""
    t = with_bounds(trades.where(F.col("ticker").isNotNull() & F.col("tx_type").isin("buy", "sell")))
    g = t.groupBy(*keys).agg(*net_columns())
    if both_sides:
        g = g.where("buys > 0 and sells > 0")
    net = F.when(F.col("known_buys") + F.col("known_sells") > 0, F.coalesce("buy_mid", F.lit(0.0)) - F.coalesce("sell_mid", F.lit(0.0)))
    return g.select(*keys, "buys", "sells", (F.col("buys") - F.col("sells")).alias("net_count"), net.alias("net_estimate"), (F.col("open_rows") > 0).alias("minimum"), "excluded")


def clusters(trades: DataFrame, least: int = 3, top: int | None = 20) -> DataFrame:
    """Tickers that at least so many different people bought: one row per buyer first, then per ticker."""
    t = with_bounds(trades.where(F.col("ticker").isNotNull() & (F.col("tx_type") == "buy")))
    latest = F.max(F.struct("disclosed_date", "filing_id", "row_index", "person_name", "party"))
    buyers = t.groupBy("ticker", "person_key").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.max("tx_date").alias("last_tx"), latest.alias("latest"))
    g = buyers.groupBy("ticker").agg(
        F.count("*").alias("buyers"), F.sum("n").alias("trades"), F.coalesce(F.sum("low"), F.lit(0)).alias("sum_low"), F.max("last_tx").alias("last_tx"),
        F.array_sort(F.collect_set("latest.party")).alias("parties"), F.max("latest")["person_name"].alias("newest_buyer"),
    ).where(F.col("buyers") >= least)
    return g.orderBy(F.desc("buyers"), F.desc("trades"), "ticker").limit(top) if top else g


def feed(trades: DataFrame, filings: DataFrame) -> DataFrame:
    """Trades and filings that need a reader, in one shape."""
    t = trades.select(F.lit("trade").alias("kind"), F.concat_ws(":", "filing_id", "row_index").alias("id"), "person_name", "ticker", "tx_type", "disclosed_date")
    r = filings.where("parse_status = 'needs_manual_review'")
    r = r.select(F.lit("review").alias("kind"), F.col("filing_id").cast("string").alias("id"), "person_name", F.col("filed_date").alias("disclosed_date"))
    return t.unionByName(r, allowMissingColumns=True)


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the feed, newest first, undated rows last."""
    return rows.orderBy(F.col("disclosed_date").desc_nulls_last(), F.desc("id")).offset(offset).limit(limit)


def span_label(low: Column, high: Column, open_rows: Column, excluded: Column) -> Column:
    """Text of a summed range; open or unreadable rows make it a minimum."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    return F.when((open_rows > 0) | (excluded > 0), F.concat(F.lit("Over "), money(low))).otherwise(F.concat(money(low), F.lit(" - "), money(high)))


def word_prefix_match(words: Column, query: str) -> Column:
    """Every token of the query begins some word."""
    tokens = [t for t in query.lower().split() if t]
    return reduce(lambda a, b: a & b, [F.exists(words, _starts(t)) for t in tokens], F.lit(True))


def _starts(token: str):
    return lambda w: w.startswith(token)


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], value: str, narrow: str | None = None) -> DataFrame:
    """left with the value of right where the keys have exactly one partner, else null.

    With narrow, a column of both, several partners of the keys are narrowed to those that have left's value of it; one has to be left.
    """
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias("_v"))
    out = left.join(one, keys, "left")
    found = F.when(F.col("_n") == 1, F.col("_v"))
    if narrow:
        among = right.groupBy(*keys, narrow).agg(F.count("*").alias("_m"), F.first(value).alias("_w"))
        out = out.join(among, [*keys, narrow], "left")
        found = found.when((F.col("_n") > 1) & (F.col("_m") == 1), F.col("_w"))
    return out.withColumn(value, found).select(*left.columns, value)


def current_filing(filings: DataFrame) -> DataFrame:
    """(person_key, filing_id, parse_status, newer_unreadable): each person's newest filing; an unreadable one falls back to the newest
    readable one of the same year only.
    """
    f = filings.withColumns({"y": F.year("filed_date"), "bad": ~F.col("parse_status").isin("parsed", "partial")})
    years = f.groupBy("person_key", "y").agg(F.max(F.struct("filed_date", "filing_id", "bad", "parse_status")).alias("newest"), F.max(F.when(~F.col("bad"), F.struct("filed_date", "filing_id", "parse_status"))).alias("readable"))
    last = years.groupBy("person_key").agg(F.max(F.struct("newest", "readable")).alias("m"))
    falls = F.col("m.newest.bad") & F.col("m.readable").isNotNull()
    pick = lambda c: F.when(falls, F.col(f"m.readable.{c}")).otherwise(F.col(f"m.newest.{c}")).alias(c)
    return last.select("person_key", pick("filing_id"), pick("parse_status"), F.col("m.newest.bad").alias("newer_unreadable"))


def presented_holdings(filings: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How a person's annual holdings are shown: (person_key, status, filing_id, newer_unreadable, n, low, high, mid, undetermined), and (person_key,
    class, n, low, mid, share) of the classes, by their middles.

    holdings: (filing_id, class, bound, low, high, mid). Undetermined values are counted apart and are in no total; one open end opens the
    total. A report that nobody could read, or that waits for a scan's reading, has no totals and no classes.
    """
    return presented(current_filing(filings), holdings)


def presented(now: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of filings that are current already; holdings of others may be left out."""
    shown = F.col("parse_status").isin("parsed", "partial")
    status = F.when(shown, F.col("parse_status")).when(F.col("parse_status") == "pending_ocr", "pending_ocr").otherwise("unreadable")
    rows = now.where(shown).select("person_key", "filing_id").join(holdings, "filing_id")
    valued = F.col("low").isNotNull() & F.col("mid").isNotNull() & F.col("bound").isin("range", "at_least")
    totals = rows.groupBy("person_key").agg(
        F.count_if(valued).alias("n"), F.sum(F.when(valued, F.col("low"))).alias("low"), F.when(F.count_if(valued & F.col("high").isNull()) == 0, F.sum(F.when(valued, F.col("high")))).alias("high"),
        F.sum(F.when(valued, F.col("mid"))).alias("mid"), F.count_if(F.col("bound") == "undetermined").alias("undetermined"),
    )
    head = now.select("person_key", status.alias("status"), "filing_id", "newer_unreadable").join(totals, "person_key", "left")
    zero = F.when(F.col("status").isin("parsed", "partial"), 0)
    head = head.select("person_key", "status", "filing_id", "newer_unreadable", *(F.coalesce(c, zero).cast("long").alias(c) for c in ("n", "low")), F.when(F.col("n").isNull(), zero.cast("long")).otherwise(F.col("high")).alias("high"), *(F.coalesce(c, zero).cast("long").alias(c) for c in ("mid", "undetermined")))
    classes = rows.where(valued).groupBy("person_key", "class").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("mid").alias("mid"))
    # The whole is summed over the classes, so rows are joined once.
    whole = F.sum("mid").over(Window.partitionBy("person_key"))
    return head, classes.select("person_key", "class", "n", "low", "mid", (F.col("mid") / whole).alias("share"))
