"""Operators that larger queries use, each by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import books, disclosures, extract, names, risk, series, sheets, writes
from ..operators import holdings as h
from ..sources import files
from ..sources.kept import shared_folder, spread
from ..sources.tables import AMOUNT_RANGES, Tables
from .disclosures import NET, WINDOW, recent
from .holdings import LATEST, MER, current, instruments
from .pipelines import _IN, _STEM, _incoming, _stored
from .registry import query
from .series import _VERSIONED, GRID, MONTHS, grid_returns, model_returns, month_levels

# ---- files: written from the tables, then read by the reader itself -----------------------------------------


@query("src05_store_json", "select n_nationkey as id, n_name as name from nation")
def _(t: Tables) -> DataFrame:
    doc = t.nation.select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("x")).groupBy().agg(F.collect_list("x").alias("instruments"))
    path = shared_folder(t.spark, "store")
    doc.write.json(path)
    return files.store_json(t.spark, path, "instruments array<struct<id:bigint,name:string>>").select(F.inline("instruments"))


@query("src08_price_csv", "select symbol, date, close from daily_points where close > 0", "daily_points")
def _(t: Tables) -> DataFrame:
    """All symbols, a folder of files each."""
    path = shared_folder(t.spark, "prices")
    sheet = t.daily_points.select("symbol", F.col("date").alias("Date"), F.lit(1).alias("Open"), F.lit(1).alias("High"), F.lit(1).alias("Low"), F.col("close").alias("Close"), F.lit("x").alias("Volume"))
    sheet.write.partitionBy("symbol").option("header", True).csv(path)
    return files.price_csv(t.spark, path, ("symbol",))


@query("src14_member_index", "select s_suppkey::varchar as doc_id, s_name as last, 'Ann' as first, case when s_suppkey % 2 = 0 then 'P' else 'O' end as kind, case when s_suppkey % 3 <> 0 then date '2024-03-01' + cast(s_suppkey % 28 as int) end as filed_date from supplier")
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    date = F.when(k % 3 != 0, F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), (k % 28).cast("int")), "M/d/yyyy")).otherwise("13/13/2024")
    rows = t.supplier.select(F.col("s_name").alias("Last"), F.lit("Ann").alias("First"), F.when(k % 2 == 0, "P").otherwise("O").alias("FilingType"), date.alias("FilingDate"), k.cast("string").alias("DocID"))
    path = shared_folder(t.spark, "index")
    rows.write.format("xml").option("rowTag", "Member").save(path)
    return files.member_index(t.spark, path)


@query("src17_ocr_words", "select 1 as page, s_suppkey::double as x, 20::double as y, (s_suppkey % 100)::double as confidence, s_name as text from supplier where s_suppkey % 100 >= 60 and s_suppkey % 100 <> 61")
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    head = "level page block par line word left top width height conf text".split()
    cells = [F.lit(5), *[F.lit(1)] * 4, k, k, F.lit(20), F.lit(5), F.lit(5), k % 100, F.when(k % 100 == 61, " ").otherwise(F.col("s_name"))]
    rows = t.supplier.where(k % 100 != 61).select(*[c.alias(n) for c, n in zip(cells, head, strict=True)])
    path = shared_folder(t.spark, "words")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return files.ocr_words(t.spark, path, 60.0)


# ---- filters, sorts ---------------------------------------------------------------------------------------


@query("fil01_renamed_record", 'select s_suppkey as "suppKey", s_name as "suppName", s_acctbal as "accountBalance" from supplier')
def _(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("suppKey"), F.col("s_name").alias("suppName"), F.col("s_acctbal").alias("accountBalance"))


@query("fil03_null_tolerant_bound", "select filing_id, 'open' as bound from filings where office = 'house' union all select filing_id, 'since' from filings where office = 'house' and filed_date >= date '1997-01-01'", "filings")
def _(t: Tables) -> DataFrame:
    f = t.filings.withColumn("disclosed_date", F.col("filed_date"))
    sides = [f.where(disclosures.feed_filter(office="house", since=s)).select("filing_id", F.lit(b).alias("bound")) for b, s in (("open", None), ("since", "1997-01-01"))]
    return sides[0].unionByName(sides[1])


@query("fil09_enum_and_class", "select filing_id, row_index from trades where tx_type in ('buy', 'sell') and asset_class in ('stock', 'etf', 'fund')", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where(F.col("tx_type").isin("buy", "sell") & F.col("asset_class").isin(*disclosures.MATCHABLE)).select("filing_id", "row_index")


@query("fil11_positive_values", "select symbol, date, close from daily_points where close > 0", "daily_points")
def _(t: Tables) -> DataFrame:
    return t.daily_points.where("close > 0")


def clamped(value: object, low: int, high: int, default: int) -> int:
    """A whole number between bounds; what is none gives the default."""
    try:
        return min(high, max(low, int(str(value).strip())))
    except ValueError:
        return default


@query("fil15_clamped_page", "select filing_id, filed_date from filings order by filed_date desc nulls last, filing_id desc limit 50 offset 2000", "filings")
def _(t: Tables) -> DataFrame:
    """A page that is asked for with 900 rows from the millionth on: both are clamped."""
    offset, limit = clamped("1000000", 0, 2000, 0), clamped(" 900 ", 1, 50, 40)
    return t.filings.select("filing_id", "filed_date").orderBy(F.col("filed_date").desc_nulls_last(), F.desc("filing_id")).offset(offset).limit(limit)


@query("srt02_feed_order", "select filing_id, filed_date from filings where filer_status is not null order by filed_date desc nulls last, filing_id desc limit 40", "filings")
def _(t: Tables) -> DataFrame:
    return t.filings.where("filer_status is not null").select("filing_id", "filed_date").orderBy(F.col("filed_date").desc_nulls_last(), F.desc("filing_id")).limit(40)


@query("srt04_top_of_each_side", "with g as (select l_returnflag, l_suppkey, count(*) as n from lineitem group by 1, 2) select l_returnflag, l_suppkey, n from g qualify row_number() over (partition by l_returnflag order by n desc, l_suppkey) <= 5")
def _(t: Tables) -> DataFrame:
    return books.newest(t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n")), ["l_returnflag"], [F.desc("n"), F.col("l_suppkey")], 5)


@query("srt05_top_clusters", "with b as (select ticker, person_key, count(*) as n from trades where ticker is not null and tx_type = 'buy' group by 1, 2) select ticker, count(*) as buyers, sum(n)::bigint as trades from b group by 1 having count(*) >= 3 order by buyers desc, trades desc, ticker limit 20", "trades")
def _(t: Tables) -> DataFrame:
    return disclosures.clusters(t.trades).select("ticker", "buyers", "trades")


@query("srt06_top_tickers", "select ticker, count(*) as n from trades where ticker is not null group by 1 order by n desc, ticker limit 8", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where("ticker is not null").groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(8)


# ---- writes ---------------------------------------------------------------------------------------------


@query("snk03_merge_series", f"with {_IN}, m as (select symbol, date, close from inc union all select symbol, date, close from st where (symbol, date) not in (select (symbol, date) from inc)) select symbol, count(*) as n, min(date) as first, max(date) as last, round(sum(close), 4) as total from m group by 1", "daily_points")
def _(t: Tables) -> DataFrame:
    m = writes.upsert(_stored(t), _incoming(t), ["symbol", "date"])
    return m.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.sum("close"), 4).alias("total"))


@query("snk05_apply_modes", f"with {_IN} select 'overwrite' as mode, count(*) as n from inc union all select 'only_missing', count(*) from inc where (symbol, date) not in (select (symbol, date) from st)", "daily_points")
def _(t: Tables) -> DataFrame:
    missing = writes.only_missing(_stored(t), _incoming(t), ["symbol", "date"])
    both = _incoming(t).select(F.lit("overwrite").alias("mode")).unionByName(missing.select(F.lit("only_missing").alias("mode")))
    return both.groupBy("mode").agg(F.count("*").alias("n"))


# ---- joins, aggregates, windows --------------------------------------------------------------------------


@query("joi15_common_weight", """with f as (select model_key, min(effective_date) as a, max(effective_date) as b from version_holdings group by 1)
select f.model_key, round(sum(least(x.weight, y.weight)), 8) as common, count(*) as shared from f join version_holdings x on x.model_key = f.model_key and x.effective_date = a join version_holdings y on y.model_key = f.model_key and y.effective_date = b and y.instrument = x.instrument group by 1""", "version_holdings")
def _(t: Tables) -> DataFrame:
    """What the first and the last mix of each model have in common."""
    v = t.version_holdings
    ends = v.groupBy("model_key").agg(F.min("effective_date").alias("a"), F.max("effective_date").alias("b"))
    x, y = (v.join(ends.select("model_key", F.col(e).alias("effective_date")), ["model_key", "effective_date"]).select("model_key", "instrument", F.col("weight").alias(f"w{e}")) for e in "ab")
    return x.join(y, ["model_key", "instrument"]).groupBy("model_key").agg(F.round(F.sum(F.least("wa", "wb")), 8).alias("common"), F.count("*").alias("shared"))


@query("agg04_net_presentation", f"with {WINDOW}, n as (select ticker, {NET} from w where ticker is not null and tx_type in ('buy', 'sell') group by 1) select ticker, case when net_count > 0 then 'net buys' when net_count < 0 then 'net sells' else 'even' end as direction, abs(net_count) as size, net_estimate is null as unknown, minimum from n", "bounded")
def _(t: Tables) -> DataFrame:
    n = disclosures.nets(recent(t), ["ticker"], both_sides=False)
    way = F.when(F.col("net_count") > 0, "net buys").when(F.col("net_count") < 0, "net sells").otherwise("even")
    return n.select("ticker", way.alias("direction"), F.abs("net_count").alias("size"), F.col("net_estimate").isNull().alias("unknown"), "minimum")


@query("agg06_first_by_order", "select ticker, arg_max(person_name, {'a': disclosed_date, 'b': filing_id, 'c': row_index}) as newest from trades where ticker is not null group by 1", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where("ticker is not null").groupBy("ticker").agg(F.max_by("person_name", F.struct("disclosed_date", "filing_id", "row_index")).alias("newest"))


@query("agg07_sorted_distinct", "select ticker, list_sort(list(distinct party)) as parties from trades where ticker is not null group by 1", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where("ticker is not null").groupBy("ticker").agg(F.array_sort(F.collect_set("party")).alias("parties"))


@query("agg08_groups_of_a_side", "select tx_type, count(distinct ticker) as tickers from trades where ticker is not null and tx_type in ('buy', 'sell') group by 1", "trades")
def _(t: Tables) -> DataFrame:
    return disclosures.side_ranking(t.trades, top=1).select("tx_type", F.col("side_tickers").alias("tickers"))


@query("agg17_compounded", f"with {GRID} select symbol, year(month) as year, round(exp(sum(ln(1 + coalesce(r, 0)))) - 1, 8) as r from rt group by 1, 2", "price_points")
def _(t: Tables) -> DataFrame:
    return grid_returns(t).groupBy("symbol", F.year("month").cast("long").alias("year")).agg(F.round(series.compounded(F.col("r")), 8).alias("r"))


@query("win12_slices", f"""with {GRID}, k as (select *, row_number() over (partition by symbol order by month desc) as j, max(year(month)) over (partition by symbol) as y from rt where r is not null)
select symbol, round(exp(sum(ln(1 + r))) - 1, 8) as since_inception, round(exp(sum(ln(1 + r)) filter (j <= 12)) - 1, 8) as last_12, round(exp(sum(ln(1 + r)) filter (year(month) = y)) - 1, 8) as ytd from k group by 1""", "price_points")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol")
    x = grid_returns(t).where("r is not null").withColumns({"j": F.row_number().over(w.orderBy(F.desc("month"))), "y": F.max(F.year("month")).over(w)})
    total = lambda c: F.round(F.exp(F.sum(F.when(c, F.log1p("r")))) - 1, 8)
    return x.groupBy("symbol").agg(total(F.lit(True)).alias("since_inception"), total(F.col("j") <= 12).alias("last_12"), total(F.year("month") == F.col("y")).alias("ytd"))


@query("agg28_queue_progress", "select count(*) filter (parse_status = 'needs_manual_review') as queued, count(*) filter (parse_status = 'parsed') as done, count(*) filter (parse_status = 'partial') as failed, count(*) filter (parse_status <> 'parsed') as remaining from filings", "filings")
def _(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("parse_status") == s)
    return t.filings.agg(n("needs_manual_review").alias("queued"), n("parsed").alias("done"), n("partial").alias("failed"), F.count_if(F.col("parse_status") != "parsed").alias("remaining"))


# ---- dates, numbers, arrays --------------------------------------------------------------------------------


@query("dat01_month_grid", f"with {MONTHS} select symbol, month, last_day(month) as month_end, strftime(month, '%Y-%m') as ym from (select distinct symbol from me), (select cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from me)", "price_points")
def _(t: Tables) -> DataFrame:
    return series.month_grid(month_levels(t)).select("symbol", "month", F.last_day("month").alias("month_end"), F.date_format("month", "yyyy-MM").alias("ym"))


@query("dat02_add_months", "select o_orderkey, strftime(cast(o_orderdate as date) + to_months(cast(o_orderkey % 30 as int)), '%Y-%m') as later, strftime(cast(o_orderdate as date) - interval 14 month, '%Y-%m') as before from orders")
def _(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(F.add_months(d, (F.col("o_orderkey") % 30).cast("int")), "yyyy-MM").alias("later"), F.date_format(F.add_months(d, -14), "yyyy-MM").alias("before"))


@query("dat05_period_ends", "select symbol, date, cast(date_trunc('month', date) as date) - 1 as month, cast(date_trunc('quarter', date) as date) - 1 as quarter, cast(date_trunc('year', date) as date) - 1 as year from daily_points", "daily_points")
def _(t: Tables) -> DataFrame:
    return t.daily_points.select("symbol", "date", *[F.date_sub(F.trunc("date", u), 1).alias(u) for u in ("month", "quarter", "year")])


@query("dat06_year_fraction", "select o_orderkey, round(date_diff('day', cast(o_orderdate as date), date '2000-01-01') / 365.25, 8) as years from orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")) / 365.25, 8).alias("years"))


@query("dat07_window_starts", """with a as (select symbol, max(date) as d from daily_points group by 1), w as (select symbol, unnest([{'l': 'MTD', 's': date_trunc('month', d) - interval 1 day}, {'l': 'QTD', 's': date_trunc('quarter', d) - interval 1 day}, {'l': 'YTD', 's': date_trunc('year', d) - interval 1 day},
  {'l': '1Y', 's': d - interval 12 month}, {'l': '3Y', 's': d - interval 36 month}, {'l': '5Y', 's': d - interval 60 month}, {'l': '10Y', 's': d - interval 120 month}, {'l': '15Y', 's': d - interval 180 month}, {'l': '20Y', 's': d - interval 240 month}]) as x from a) select symbol, x.l as label, cast(x.s as date) as start from w""", "daily_points")
def _(t: Tables) -> DataFrame:
    return t.daily_points.groupBy("symbol").agg(F.max("date").alias("d")).select("symbol", F.inline(series.window_starts(F.col("d"))))


@query("dat08_lag_days", "select filing_id, row_index, date_diff('day', tx_date, disclosed_date) as lag, disclosed_date + 45 as due from trades", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.select("filing_id", "row_index", F.datediff("disclosed_date", "tx_date").cast("long").alias("lag"), F.date_add("disclosed_date", 45).alias("due"))


@query("dat09_us_dates", "select o_orderkey, case when o_orderkey % 4 < 2 then cast(o_orderdate as date) end as d from orders")
def _(t: Tables) -> DataFrame:
    """Real dates between 1990 and 2100; a 31st of February and a date of 1899 are none."""
    d, m = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    s = F.when(m == 0, F.date_format(d, "M/d/yyyy")).when(m == 1, F.date_format(d, "MM/dd/yyyy")).when(m == 2, "2/31/1996").otherwise("1/1/1899")
    return t.orders.select("o_orderkey", text.loose_date(s).alias("d"))


@query("dat14_summary_bounds", "select n as days, date '1998-06-30' - cast(n - 1 as int) as start, date '1998-06-30' as until, (select count(*) from trades where disclosed_date between date '1998-06-30' - cast(n - 1 as int) and date '1998-06-30') as trades from (select unnest([7, 30, 90]) as n)", "trades")
def _(t: Tables) -> DataFrame:
    end = F.lit("1998-06-30").cast("date")
    parts = [disclosures.in_window(t.trades, "1998-06-30", n).groupBy().agg(F.count("*").alias("trades")).select(F.lit(n).alias("days"), F.date_sub(end, n - 1).alias("start"), end.alias("until"), "trades") for n in (7, 30, 90)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("mth02_annualized", f"with {GRID} select symbol, round(pow(exp(sum(ln(1 + r))), 12 / count(r)::double) - 1, 8) as yearly, round(pow(1.04::double, 1 / 12.0::double) - 1, 10) as monthly_rf from rt where r is not null group by 1", "price_points")
def _(t: Tables) -> DataFrame:
    x = grid_returns(t).where("r is not null").groupBy("symbol").agg(F.sum(F.log1p("r")).alias("g"), F.count("*").alias("n"))
    return x.select("symbol", F.round(F.exp(F.col("g") * 12 / F.col("n")) - 1, 8).alias("yearly"), F.round(F.lit(1.04 ** (1 / 12) - 1), 10).alias("monthly_rf"))


@query("mth03_guarded_ratio", "select l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 8) as ratio from lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_tax", "l_discount"), 8).alias("ratio"))


@query("mth04_drawdown", "select symbol, date, round(case when close > 0 and ref > 0 then close / ref - 1 end, 8) as drawdown from (select *, max(close) over (partition by symbol order by date) as ref from daily_points)", "daily_points")
def _(t: Tables) -> DataFrame:
    ref = F.max("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    x = t.daily_points.withColumn("ref", ref)
    return x.select("symbol", "date", F.round(F.when((F.col("close") > 0) & (F.col("ref") > 0), F.col("close") / F.col("ref") - 1), 8).alias("drawdown"))


@query("mth05_midpoints", "select amount_range, count(*) as n, any_value(case when high is null then low::double else (low + high) / 2.0::double end) as mid from bounded where low is not null group by 1", "bounded")
def _(t: Tables) -> DataFrame:
    return disclosures.with_bounds(t.trades).where("low is not null").groupBy("amount_range").agg(F.count("*").alias("n"), F.first("mid").alias("mid"))


@query("mth07_portfolio_variance", f"""with {GRID}, {LATEST}, x as (select * from rt where r is not null), s as (select a.symbol as a, b.symbol as b, coalesce(covar_samp(a.r, b.r), 0) * 12 as cov from x a join x b using (month) group by 1, 2)
select p.model_key, round(sum(p.weight * q.weight * cov), 10) as variance from cur p join cur q using (model_key) join s on s.a = p.instrument and s.b = q.instrument group by 1""", "price_points version_holdings")
def _(t: Tables) -> DataFrame:
    """Pairs of holdings of one model: its size squared, as the form needs. Sigma holds each pair once."""
    cov = risk.mu_sigma(grid_returns(t))[1]
    c = current(t)
    p, q = (c.select("model_key", F.col("instrument").alias(k), F.col("weight").alias(f"w{k}")) for k in "ab")
    x = p.join(cov, "a").join(q, ["model_key", "b"])
    twice = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    return x.groupBy("model_key").agg(F.round(F.sum(F.col("wa") * F.col("wb") * F.col("cov") * twice), 10).alias("variance"))


@query("arr03_clean_breakdown", "with b as (select n_nationkey as id, x.label as label, x.share as share from nation, (select unnest([{'label': 'Energy', 'share': 2.0}, {'label': ' Health ', 'share': 6.0}, {'label': '', 'share': 1.0}, {'label': 'Tech', 'share': -1.0}]) as x)) select id, trim(label) as label, share::double / 8 as share from b where trim(label) <> '' and share > 0")
def _(t: Tables) -> DataFrame:
    raw = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(s).alias("share")) for a, s in (("Energy", 2.0), (" Health ", 6.0), ("", 1.0), ("Tech", -1.0))])
    good = F.transform(F.filter(raw, lambda p: (F.trim(p["label"]) != "") & (p["share"] > 0)), lambda p: F.struct(F.trim(p["label"]).alias("label"), p["share"].alias("share")))
    total = F.aggregate(good, F.lit(0.0), lambda a, p: a + p["share"])
    return t.nation.select(F.col("n_nationkey").alias("id"), F.inline(F.transform(good, lambda p: F.struct(p["label"].alias("label"), (p["share"] / total).alias("share")))))


# ---- finance, people -------------------------------------------------------------------------------------


@query("fin01_levels_on_grid", f"with {MONTHS}, g as (select symbol, month from (select distinct symbol from me), (select distinct month from me where month(month) % 3 = 0)) select g.symbol, g.month, (select arg_max(level, m.month) from me m where m.symbol = g.symbol and m.month = g.month) as own from g", "price_points")
def _(t: Tables) -> DataFrame:
    """A grid of quarter ends that is given: levels of its own months, before they are carried on."""
    me = month_levels(t)
    grid = me.select("symbol").distinct().join(me.where(F.month("month") % 3 == 0).select("month").distinct())
    return grid.join(me, ["symbol", "month"], "left").select("symbol", "month", F.col("level").alias("own"))


@query("fin02_returns_from_levels", "select symbol, date, round(close / nullif(lag(close) over (partition by symbol order by date), 0) - 1, 8) as r from daily_points", "daily_points")
def _(t: Tables) -> DataFrame:
    x = series.monthly_returns(t.daily_points.select("symbol", F.col("date").alias("month"), F.col("close").alias("level")))
    return x.select("symbol", F.col("month").alias("date"), F.round("r", 8).alias("r"))


@query("fin08_coverage", f"with {_VERSIONED} select model_key, round(min(coverage), 8) as least, count(*) filter (coverage < 1) as partly from mr group by 1", "price_points versions version_holdings")
def _(t: Tables) -> DataFrame:
    return model_returns(t).groupBy("model_key").agg(F.round(F.min("coverage"), 8).alias("least"), F.count_if(F.col("coverage") < 1).alias("partly"))


@query("fin09_common_start", f"with {GRID} select max(first) as start, count(*) as symbols from (select symbol, min(month) as first from rt where r is not null group by 1)", "price_points")
def _(t: Tables) -> DataFrame:
    first = grid_returns(t).where("r is not null").groupBy("symbol").agg(F.min("month").alias("first"))
    return first.agg(F.max("first").alias("start"), F.count("*").alias("symbols"))


@query("fin12_usable_returns", f"with {GRID} select symbol, count(r) as n, count(r) >= 3 as usable from rt group by 1", "price_points")
def _(t: Tables) -> DataFrame:
    return grid_returns(t).groupBy("symbol").agg(F.count("r").alias("n"), (F.count("r") >= 3).alias("usable"))


@query("fin20_compare_cards", f"""with {LATEST}, {MER}, n as (select *, count(*) over (partition by instrument) as held from cur), k as (select model_key, count(*) as holdings, round(max(weight), 8) as largest, round(coalesce(sum(weight) filter (held = 1), 0), 8) as unique_weight, list_slice(list(instrument order by weight desc, instrument), 1, 4) as top from n group by 1),
e as (select model_key, round(sum(weight * mer) / sum(weight) filter (mer is not null), 8) as mer from cur join mer using (instrument) group by 1) select k.*, mer from k join e using (model_key)""", "version_holdings")
def _(t: Tables) -> DataFrame:
    c = current(t)
    mean, _ = h.weighted_mean(F.col("mer"), F.col("weight"))
    mer = c.join(instruments(t), "instrument").groupBy("model_key").agg(F.round(mean, 8).alias("mer"))
    alone = h.shared_weight(c).select("model_key", F.round("unique_weight", 8).alias("unique_weight"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "instrument")))
    cards = c.groupBy("model_key").agg(F.count("*").alias("holdings"), F.round(F.max("weight"), 8).alias("largest"), F.slice(F.transform(ranked, lambda s: s["instrument"]), 1, 4).alias("top"))
    return cards.join(alone, "model_key").join(mer, "model_key")


@query("fin24_drawdown_basis", """with g as (select *, max(date) over (partition by symbol) as hi, max(date) over () as today from price_points where close > 0),
s as (select symbol, min(date) as first, max(date) as last, any_value(today) as today, arg_max(close, date) as close, max(close) filter (date >= hi - 364) as peak from g group by 1)
select symbol, round(close / peak - 1, 8) as drawdown, case when first <= last - 364 then '52-week high' else 'high since ' || strftime(first, '%Y-%m-%d') end as basis, today - last > 5 as stale from s""", "price_points")
def _(t: Tables) -> DataFrame:
    x = series.trailing_peak(t.price_points)
    today = x.agg(F.max("last_date").alias("today"))
    basis = F.when(F.col("covers"), "52-week high").otherwise(F.concat(F.lit("high since "), F.date_format("first_date", "yyyy-MM-dd")))
    return x.crossJoin(F.broadcast(today)).select("symbol", F.round("drawdown", 8).alias("drawdown"), basis.alias("basis"), (F.datediff("today", "last_date") > 5).alias("stale"))  # one row beside each


@query("fin28_mer_by_region", f"with {LATEST}, {MER} select region, round(sum(weight * mer) / sum(weight) filter (mer is not null), 8) as mer, round(coalesce(sum(weight) filter (mer is not null), 0) / sum(weight), 8) as known from cur join mer using (instrument) group by 1", "version_holdings")
def _(t: Tables) -> DataFrame:
    mean, known = h.weighted_mean(F.col("mer"), F.col("weight"))
    return current(t).join(instruments(t), "instrument").groupBy("region").agg(F.round(mean, 8).alias("mer"), F.round(known, 8).alias("known"))


@query("fin31_catalog", f"with c as (select {_STEM} as stem, ticker, tier from (select p_type || ' ' || p_brand || case when p_size % 2 = 0 then ' Inc.' else ' Corp' end as n, 'T' || p_size as ticker, p_size % 3 as tier from part)), b as (select *, min(tier) over (partition by stem) as best from c) select stem, min(ticker) as ticker from b where tier = best and stem <> '' group by 1 having count(distinct ticker) = 1")
def _(t: Tables) -> DataFrame:
    name = F.concat("p_type", F.lit(" "), "p_brand", F.when(F.col("p_size") % 2 == 0, " Inc.").otherwise(" Corp"))
    exchange = F.element_at(F.array(*map(F.lit, ("NYSE", "Toronto", "OTC"))), F.col("p_size") % 3 + 1)
    rows = t.part.select(name.alias("name"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("ticker"), exchange.alias("exchange"))
    return names.catalog_index(rows, names.class_listings(rows.selectExpr("name", "'' as share_class", "ticker").where("false")))[0].select("stem", "ticker")


@query("rec22_amount_bounds", "select * from (values " + ", ".join(f"('{label}', {low}::bigint, {'null' if high is None else high}::bigint)" for label, low, high in AMOUNT_RANGES) + ") as v(amount_range, low, high)")
def _(t: Tables) -> DataFrame:
    rows = t.nation.limit(1).select(F.explode(F.array(*[F.lit(r[0]) for r in AMOUNT_RANGES])).alias("amount_range"))
    return disclosures.with_bounds(rows).select("amount_range", "low", "high")


@query("rec24_value_labels", "select person_key, case when count(*) filter (high is null) > 0 then 'At least $' || format('{:,}', sum(low)::bigint) else '$' || format('{:,}', sum(low)::bigint) || ' – $' || format('{:,}', sum(high)::bigint) end as label from bounded where low is not null group by 1", "bounded")
def _(t: Tables) -> DataFrame:
    x = disclosures.with_bounds(t.trades).where("low is not null").groupBy("person_key").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.count_if(F.col("high").isNull()).alias("open"))
    closed = F.concat(money.dollars(F.col("low")), F.lit(" – "), money.dollars(F.col("high")))
    return x.select("person_key", F.when(F.col("open") > 0, F.concat(F.lit("At least "), money.dollars(F.col("low")))).otherwise(closed).alias("label"))


@query("rec28_held_tickers", f"with {LATEST} select distinct instrument from cur", "version_holdings")
def _(t: Tables) -> DataFrame:
    return current(t).select("instrument").distinct()


@query("src09_pasted_prices", "select c_custkey as id, date '2020-01-01' + cast(c_custkey % 300 as int) as date, 10.25::double + c_custkey % 7 + case when c_custkey % 3 = 0 then 5 else 0 end as close from customer")
def _(t: Tables) -> DataFrame:
    """Comma separated, with a line that holds no date and one without a price."""
    d = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd")
    close = (F.lit(10.25) + F.col("c_custkey") % 7).cast("string")
    adjusted = (F.lit(15.25) + F.col("c_custkey") % 7).cast("string")
    third = F.col("c_custkey") % 3 == 0
    row = F.concat(d, F.lit(";1;2;3;"), close, F.when(third, F.concat(F.lit(";"), adjusted)).otherwise(""), F.lit(";99"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.concat_ws("\n", F.when(third, "Date;Open;High;Low;Close;Adj Close;Volume").otherwise("Date;Open;High;Low;Close;Volume"), row, F.lit("dividend;0.1"), F.concat(d, F.lit(";-"))).alias("text"))
    return extract.price_history(rows)[0]


def price_sheets(t: Tables) -> DataFrame:
    """A sheet a customer: with a header and an adjusted close, comma separated with quoted volumes, without a header (six and two numbers)."""
    k = F.col("c_custkey")
    day = lambda n, form: F.date_format(F.date_add(F.lit("2021-01-04").cast("date"), (k % 200 + n).cast("int")), form)
    price = lambda x: F.format_number(k % 90 + F.lit(1000.5 + x), 2)
    bare = lambda x: F.replace(price(x), F.lit(","), F.lit(""))
    tab = F.concat_ws("\n", F.lit("Historical prices\nDate  Open  High  Low  Close  Adj Close  Volume"), F.concat_ws("   ", day(0, "MMM d, yyyy"), F.lit("1"), F.lit("2"), F.lit("3"), price(0), price(-1), F.lit("1,000")), F.concat_ws("  ", day(1, "MMM d, yyyy"), F.lit("0.24 Dividend")), F.concat_ws("  ", day(2, "MMM d, yyyy"), F.lit("4:1 Stock Splits")), F.concat_ws("  ", day(3, "MMM d, yyyy"), F.lit("1"), F.lit("2")))
    csv = F.concat_ws("\n", F.lit("Date,Close,Volume"), F.concat(day(0, "yyyy-MM-dd"), F.lit(","), bare(0), F.lit(',"900,000"')), F.concat(day(0, "yyyy-MM-dd"), F.lit(","), bare(5), F.lit(',"1"')), F.concat(day(1, "yyyy-MM-dd"), F.lit(",,5")), F.lit("2021-02-30,7,8"))
    six = F.concat_ws("\n", F.concat_ws(" ", day(0, "M/d/yyyy"), F.lit("1 2 3"), price(0), price(1), F.lit("77")), F.concat_ws(" ", day(1, "M/d/yyyy"), F.lit("1 2 3 9.5 9.5 77")), F.concat_ws(" ", day(2, "M/d/yyyy"), F.lit("1 2 3")))
    two = F.concat_ws("\n", F.concat_ws(" ", day(0, "M/d/yyyy"), price(0), price(2)), F.concat_ws(" ", day(1, "M/d/yyyy"), F.lit("closed")))
    return t.customer.select(k.alias("id"), F.when(k % 4 == 0, tab).when(k % 4 == 1, csv).when(k % 4 == 2, six).otherwise(two).alias("text"))


_SHEET = "s as (select c_custkey as id, c_custkey % 4 as k, date '2021-01-04' + cast(c_custkey % 200 as int) as d, c_custkey % 90 + 1000.5::double as p from customer)"


@query("src10_sheet_points", f"""with {_SHEET} select id, d as date, p as close, p - 1 as adj, false as sudden from s where k = 0 union all select id, d, p + 5, null, false from s where k = 1
union all select id, d, p, p + 1, false from s where k = 2 union all select id, d + 1, 9.5, 9.5, true from s where k = 2 union all select id, d, p, p + 2, false from s where k = 3""")
def _(t: Tables) -> DataFrame:
    return sheets.price_sheet(price_sheets(t))[0]


@query("src10_sheet_events", f"with {_SHEET} select id, d + 1 as date, 'dividend' as kind, 0.24::double as amount from s where k = 0 union all select id, d + 2, 'split', null from s where k = 0")
def _(t: Tables) -> DataFrame:
    return sheets.price_sheet(price_sheets(t))[1].drop("raw")


@query("src10_sheet_counts", f"""with {_SHEET} select id, case k when 2 then 2 else 1 end::bigint as points, (k = 0)::bigint as dividends, (k = 0)::bigint as splits, 1::bigint as incomplete, (k = 1)::bigint as duplicates, (k = 1)::bigint as invalid, (k = 1)::bigint as "unlike" from s""")
def _(t: Tables) -> DataFrame:
    return sheets.price_sheet(price_sheets(t))[2]


@query("src10_history_counters", "select c_custkey as id, 1::bigint as rows, 3::bigint as skipped from customer")
def _(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.lit("Date\tClose\n2024-01-02\t5.5\nsplit 2:1\n2024-01-03\t-1\n").alias("text"))
    return extract.price_history(rows)[1]


@query("rec10_upload_previews", """with k as (select c_custkey as id, c_custkey % 4 as k, c_custkey % 14 as n, c_custkey % 5 as h, date '2021-01-04' + cast(c_custkey % 200 as int) as d from customer),
s as (select id, d + i::int as date, 100.5 + i::double as close, case when i % 2 = 0 then 99.5 + i::double end as adj, i from k, range(14) r(i) where i < n), a as (select id, list({'date': date, 'close': close, 'adj': adj} order by date) as s, count(*) as rows, min(date) as first_date, max(date) as last_date, max(close) as last_close from s group by 1)
select k.id, case when k = 0 then null else 'ABC' end as ticker, case when k = 1 then null else 'USD' end as currency, coalesce(rows, 0) as rows, first_date, last_date, last_close, case when rows > 10 then s[1:5] else coalesce(s, []) end as head, case when rows > 10 then s[-5:] else [] end as tail,
case when k <> 0 then h <> 0 end as ticker_match, k <> 1 and h = 1 as currency_mismatch, 1::bigint as skipped, 0::bigint as sudden, greatest(n - 3, 0)::bigint as added, (n > 1)::bigint as changed, least(greatest(n, 0), 3)::bigint - (n > 1)::bigint as unchanged from k left join a using (id)""")
def _(t: Tables) -> DataFrame:
    """Uploads of up to 13 days; three days are stored, one of them otherwise."""
    k = F.col("c_custkey")
    first = F.date_add(F.lit("2021-01-04").cast("date"), (k % 200).cast("int"))
    day = lambda i: F.concat_ws("  ", F.date_format(F.date_add(first, i), "MMM d, yyyy"), (F.lit(100.5) + i).cast("string"), F.when(i % 2 == 0, (F.lit(99.5) + i).cast("string")))
    days = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(13)), lambda i: i < k % 14), day), "\n")
    head = F.concat_ws("\n", F.when(k % 4 != 0, "Acme Inc. (ABC)"), F.when(k % 4 != 1, "Currency in USD"), F.lit("Date  Close  Adj Close"))
    docs = spread(t.customer.select("c_custkey")).select(k.alias("id"), F.concat_ws("\n", head, days, F.lit("Jan 5, 2021  no trade")).alias("text"))
    stored = t.customer.select(k.alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.date_add(first, i).alias("date"), (F.lit(100.5) + F.when(i == 1, 50).otherwise(i)).alias("close")))).alias("p")).select("id", "p.*")
    holdings = t.customer.select(k.alias("id"), F.when(k % 5 == 0, "XYZ").otherwise("abc").alias("symbol"), F.when(k % 5 == 1, "CAD").otherwise("usd").alias("currency"))
    return sheets.preview(docs, stored, holdings)


@query("rec17_seeded", "select 'kept' as part, n_nationkey as id from nation union all select 'seeded', r_regionkey from region")
def _(t: Tables) -> DataFrame:
    """A table that has rows keeps them; one that has none gets the seed."""
    seed = t.region.select(F.col("r_regionkey").alias("id"))
    stored = t.nation.select(F.col("n_nationkey").alias("id"))
    both = ((n, writes.seed_if_empty(s, seed)) for n, s in (("kept", stored), ("seeded", stored.where("id < 0"))))
    out = [x.select(F.lit(n).alias("part"), "id") for n, x in both]
    return out[0].unionByName(out[1])
