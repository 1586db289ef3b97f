"""Queries on price series, model versions and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import risk, series
from ..sources.kept import kept
from ..sources.tables import Tables
from .registry import query

MONTHS = "me as (select symbol, cast(date_trunc('month', date) as date) as month, arg_max(close, date) as level from price_points group by 1, 2)"
GRID = f"""{MONTHS}, g as (select symbol, month from (select distinct symbol from me), (select cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from me)),
lv as (select symbol, month, last_value(level ignore nulls) over (partition by symbol order by month rows unbounded preceding) as level from g left join me using (symbol, month)),
rt as (select symbol, month, level, level / nullif(lag(level) over (partition by symbol order by month), 0) - 1 as r from lv)"""
BOOK = """sy as (select symbol, row_number() over (order by symbol) as i, count(*) over () as n from (select distinct symbol from price_points)),
bk as (select symbol, (n + 1 - i) / (n * (n + 1) / 2.0::double) as weight from sy), bm as (select symbol, i / (n * (n + 1) / 2.0::double) as weight from sy)"""


def book(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Fixed weights of all n symbols by name, in proportion to n down to 1; the benchmark's from 1 up to n."""
    s = grid_returns(t).select("symbol").distinct()
    s = s.withColumns({"i": F.row_number().over(Window.orderBy("symbol")), "n": F.count("*").over(Window.partitionBy())})  # a row for each symbol
    whole = F.col("n") * (F.col("n") + 1) / F.lit(2.0)
    return s.select("symbol", ((F.col("n") + 1 - F.col("i")) / whole).alias("weight")), s.select("symbol", (F.col("i") / whole).alias("weight"))


def month_levels(t: Tables) -> DataFrame:
    """Month-end levels, a row for each symbol and month: written once for all parts of a query."""
    if "month_levels" not in t.__dict__:
        t.__dict__["month_levels"] = kept(series.month_end(t.price_points), "month_levels")
    return t.__dict__["month_levels"]


def grid_returns(t: Tables) -> DataFrame:
    if "grid_returns" not in t.__dict__:
        t.__dict__["grid_returns"] = kept(series.monthly_returns(series.levels_on_grid(month_levels(t))), "grid_returns")
    return t.__dict__["grid_returns"]


@query("src03_price_window", "select symbol, date, close from price_points where date >= date '1996-03-01' and date <= date '1996-06-30' and symbol >= 'N'", "price_points")
def _(t: Tables) -> DataFrame:
    return t.price_points.where(F.col("date").between("1996-03-01", "1996-06-30") & (F.col("symbol") >= "N"))


@query("src04_daily_window", "select symbol, date, close from daily_points where date >= date '2024-01-10'", "daily_points")
def _(t: Tables) -> DataFrame:
    return t.daily_points.where("date >= '2024-01-10'")


@query("agg15_month_end", f"with {MONTHS} select * from me", "price_points")
def _(t: Tables) -> DataFrame:
    return series.month_end(t.price_points)


@query("win04_forward_fill", f"with {GRID} select symbol, month, level from lv", "price_points")
def _(t: Tables) -> DataFrame:
    return series.levels_on_grid(month_levels(t))


@query("joi12_grid_join", f"with {GRID} select symbol, month, level from g left join me using (symbol, month)", "price_points")
def _(t: Tables) -> DataFrame:
    me = month_levels(t)
    return series.month_grid(me).join(me, ["symbol", "month"], "left")


@query("win06_monthly_returns", f"with {GRID} select symbol, month, round(r, 8) as r from rt", "price_points")
def _(t: Tables) -> DataFrame:
    return grid_returns(t).select("symbol", "month", F.round("r", 8).alias("r"))


@query("win07_strict_support", f"""with {MONTHS}, s as (select symbol, month, level, lag(month) over w as pm, lag(level) over w as pl from me window w as (partition by symbol order by month))
select symbol, month, round(level / pl - 1, 8) as r from s where pm = month - interval 1 month and pl <> 0""", "price_points")
def _(t: Tables) -> DataFrame:
    return series.strict_returns(series.month_end(t.price_points)).withColumn("r", F.round("r", 8))


@query("win08_month_runs", f"""with {MONTHS}, s as (select symbol, month, year(month) * 12 + month(month) - row_number() over (partition by symbol order by month) as k from me)
select symbol, min(month) as first_month, max(month) as last_month, count(*) as n from s group by symbol, k""", "price_points")
def _(t: Tables) -> DataFrame:
    return series.runs_of_months(series.month_end(t.price_points))


@query("win08_latest_run", f"""with {MONTHS}, s as (select symbol, month, year(month) * 12 + month(month) - row_number() over (partition by symbol order by month) as k from me),
u as (select symbol, min(month) as first_month, max(month) as last_month, count(*) as n from s group by symbol, k) select * from u qualify row_number() over (partition by symbol order by last_month desc) = 1""", "price_points")
def _(t: Tables) -> DataFrame:
    return series.latest_run(series.month_end(t.price_points))


@query("agg14_snapshot_drawdown", """with g as (select *, max(date) over (partition by symbol) as last_date from price_points where close > 0),
s as (select symbol, count(*) as n, min(date) as first_date, max(date) as last_date, arg_max(close, date) as last_close from g group by symbol),
p as (select symbol, date as peak_date, close as peak_close from g where date >= last_date - 364 qualify row_number() over (partition by symbol order by close desc, date desc) = 1)
select symbol, n, first_date, s.last_date, last_close, peak_date, peak_close, round(last_close / peak_close - 1, 8) as drawdown, first_date <= s.last_date - 364 as covers from s join p using (symbol)""", "price_points")
def _(t: Tables) -> DataFrame:
    return series.trailing_peak(t.price_points).withColumn("drawdown", F.round("drawdown", 8))


@query("win05_rolling_peak", "select symbol, date, max(close) over (partition by symbol order by date range between interval 364 days preceding and current row) as peak from daily_points", "daily_points")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-364, 0)
    return t.daily_points.select("symbol", "date", F.max("close").over(w).alias("peak"))


@query("joi10_as_of", """with q as (select symbol, date - 3 as ask from daily_points)
select q.symbol, ask, p.date as asof_date, p.close as asof_value from q asof left join daily_points p on q.symbol = p.symbol and q.ask >= p.date""", "daily_points")
def _(t: Tables) -> DataFrame:
    asks = t.daily_points.select("symbol", F.date_sub("date", 3).alias("ask"))
    return series.as_of(asks, t.daily_points, "ask", "date", "close")


_PERIODS = """with a as (select symbol, max(date) as as_of from price_points group by 1),
w as (select symbol, as_of, unnest([{'l': 'MTD', 's': date_trunc('month', as_of) - interval 1 day}, {'l': 'QTD', 's': date_trunc('quarter', as_of) - interval 1 day}, {'l': 'YTD', 's': date_trunc('year', as_of) - interval 1 day},
  {'l': '1Y', 's': as_of - interval 12 month}, {'l': '3Y', 's': as_of - interval 36 month}, {'l': '5Y', 's': as_of - interval 60 month},
  {'l': '10Y', 's': as_of - interval 120 month}, {'l': '15Y', 's': as_of - interval 180 month}, {'l': '20Y', 's': as_of - interval 240 month}]) as x from a),
v as (select symbol, as_of, x.l as label, cast(x.s as date) as start from w),
b as (select v.*, p.date as base_date, p.close as base from v asof left join price_points p on v.symbol = p.symbol and v.start >= p.date),
e as (select b.*, p.date as end_date, p.close as top from b asof left join price_points p on b.symbol = p.symbol and b.as_of >= p.date),
f as (select *, case when base <> 0 and end_date > base_date then top / base - 1 end as q, date_diff('day', base_date, end_date) as days from e),
n as (select f.symbol, label, count(p.date) as points from f join price_points p on p.symbol = f.symbol and p.date > base_date and p.date <= end_date group by 1, 2)
select f.symbol, f.label, start, base_date, end_date, round(q, 8) as ret, round(case when f.label in ('3Y', '5Y', '10Y', '15Y', '20Y') and 1 + q >= 0 then pow(1 + q, 365.25 / days) - 1 end, 8) as annualized,
  case when q is not null then days * 252 / 365.25 >= 3 and coalesce(points, 0) < 0.9 * days * 252 / 365.25 end as estimate from f left join n on n.symbol = f.symbol and n.label = f.label"""


@query("fin17_period_returns", _PERIODS, "price_points")
def _(t: Tables) -> DataFrame:
    asks = t.price_points.groupBy("symbol").agg(F.max("date").alias("as_of"))
    return series.period_returns(t.price_points, asks).withColumns({c: F.round(c, 8) for c in ("ret", "annualized")})


@query("win14_sudden_moves", """with s as (select symbol, date, close, lag(close) over w as before, date_diff('day', lag(date) over w, date) as days from daily_points window w as (partition by symbol order by date))
select * from s where before > 0 and days <= 5 and abs(close / before - 1) > 0.4""", "daily_points")
def _(t: Tables) -> DataFrame:
    return series.sudden_moves(t.daily_points)


@query("win16_sparkline", """with s as (select symbol, date, close, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as m from price_points),
k as (select distinct symbol, cast(floor(x * (m - 1) / 39.0::double + 0.5) as bigint) as i from (select distinct symbol, m from s), range(40) as r(x))
select symbol, i, date, close from s where m <= 40 or exists (select 1 from k where k.symbol = s.symbol and k.i = s.i)""", "price_points")
def _(t: Tables) -> DataFrame:
    return series.sparkline(t.price_points)


@query("win17_head_tail", """select symbol, date, close from (select *, row_number() over (partition by symbol order by date) as a, row_number() over (partition by symbol order by date desc) as b from price_points) where a <= 5 or b <= 5""", "price_points")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol")
    x = t.price_points.withColumns({"a": F.row_number().over(w.orderBy("date")), "b": F.row_number().over(w.orderBy(F.desc("date")))})
    return x.where("a <= 5 or b <= 5").select("symbol", "date", "close")


@query("win21_thin_sample", """with s as (select symbol, max(date) as hi from price_points group by 1), c as (select symbol, count(*) as n from price_points join s using (symbol) where date > hi - 365 and date <= hi group by 1)
select symbol, n, n < 0.9 * 365 * 252 / 365.25 as thin from c""", "price_points")
def _(t: Tables) -> DataFrame:
    hi = F.max("date").over(Window.partitionBy("symbol"))
    x = t.price_points.withColumn("hi", hi).where(F.col("date") > F.date_sub("hi", 365)).groupBy("symbol").agg(F.count("*").alias("n"))
    return x.withColumn("thin", F.col("n") < 0.9 * 365 * 252 / 365.25)


@query("fin11_static_blend", f"with {GRID}, {BOOK} select month, round(sum(weight * r) / sum(case when r is not null then weight end), 8) as r, round(coalesce(sum(case when r is not null then weight end), 0) / sum(weight), 8) as coverage from rt join bk using (symbol) group by month", "price_points")
def _(t: Tables) -> DataFrame:
    x = series.blend(grid_returns(t), book(t)[0])
    return x.select("month", F.round("r", 8).alias("r"), F.round("coverage", 8).alias("coverage"))


_JOINT = f"""{GRID}, {BOOK}, pr as (select month, sum(weight * r) / sum(case when r is not null then weight end) as r from rt join bk using (symbol) group by month),
pb as (select month, sum(weight * r) / sum(case when r is not null then weight end) as b from rt join bm using (symbol) group by month), j as (select month, r, b from pr left join pb using (month) where r is not null)"""
_RISK = f"""with {_JOINT}, k as (select pow(1.04::double, 1 / 12.0::double) - 1 as f),
l as (select month, exp(sum(ln(1 + r)) over (order by month)) as lev from j), dd as (select least(0, min(lev / pk - 1)) as mdd from (select lev, greatest(1, max(lev) over (order by month)) as pk from l)),
a as (select count(*) as n, exp(sum(ln(1 + r)) * 12 / count(*)) - 1 as ann, stddev_samp(r) * sqrt(12::double) as vol, sqrt(avg(least(0, r - f) ** 2)) * sqrt(12::double) as dsemi,
  exp(sum(ln(1 + b)) * 12 / count(b)) - 1 as bann, exp(sum(case when b is not null then ln(1 + r) end) * 12 / count(b)) - 1 as jann, covar_samp(r, b) as cov, var_samp(case when b is not null then b end) as vb,
  stddev_samp(case when b is not null then r end) as sr, stddev_samp(b) as sb, stddev_samp(r - b) * sqrt(12::double) as te, avg(case when b is not null then r end) as mr, avg(b) as mb,
  product(case when b > 0 then 1 + r end) - 1 as ru, product(case when b > 0 then 1 + b end) - 1 as bu, product(case when b < 0 then 1 + r end) - 1 as rd, product(case when b < 0 then 1 + b end) - 1 as bd, any_value(f) as f from j, k)
select n, round(ann, 8) as ann_return, round(vol, 8) as volatility, round(dsemi, 8) as downside, round((ann - 0.04) / vol, 8) as sharpe, round((ann - 0.04) / dsemi, 8) as sortino, round(cov / vb, 8) as beta,
  round((mr - f - cov / vb * (mb - f)) * 12, 8) as alpha, round(cov / (sr * sb), 8) as correlation, round(te, 8) as tracking_error, round(bann, 8) as bench_return, round(jann - bann, 8) as active_return,
  round((jann - bann) / te, 8) as info_ratio, round(ru / bu, 8) as up_capture, round(rd / bd, 8) as down_capture, round(mdd, 8) as max_drawdown from a, dd"""


def joint(t: Tables) -> DataFrame:
    weights, bench = book(t)
    r = grid_returns(t)
    b = series.blend(r, bench).select("month", F.col("r").alias("b"))
    return series.blend(r, weights).join(b, "month", "left").select("month", "r", "b")


@query("fin10_risk_metrics", _RISK, "price_points")
def book_risk(t: Tables) -> DataFrame:
    return risk.risk_metrics(joint(t), [])


@query("win11_max_drawdown", f"""with {GRID}, c as (select symbol, month, exp(sum(ln(1 + r)) over (partition by symbol order by month)) as lev from rt where r is not null),
p as (select symbol, lev, greatest(1, max(lev) over (partition by symbol order by month)) as pk from c) select symbol, round(least(0, min(lev / pk - 1)), 8) as max_drawdown from p group by symbol""", "price_points")
def _(t: Tables) -> DataFrame:
    x = risk.max_drawdown(grid_returns(t).where("r is not null"), ["symbol"])
    return x.select("symbol", F.round("max_drawdown", 8).alias("max_drawdown"))


@query("fin25_instrument_stats", f"""with {GRID}, a as (select symbol, count(*) as months, exp(sum(ln(1 + r)) * 12 / count(*)) - 1 as ann, stddev_samp(r) * sqrt(12::double) as vol from rt where r is not null group by 1)
select symbol, months, round(ann, 8) as ann_return, round(vol, 8) as volatility, months < 24 as estimate from a""", "price_points")
def _(t: Tables) -> DataFrame:
    a = grid_returns(t).where("r is not null").groupBy("symbol").agg(F.count("*").alias("months"), F.sum(F.log1p("r")).alias("g"), F.stddev_samp("r").alias("s"))
    return a.select("symbol", "months", F.round(F.exp(F.col("g") * 12 / F.col("months")) - 1, 8).alias("ann_return"), F.round(F.col("s") * 12**0.5, 8).alias("volatility"), (F.col("months") < 24).alias("estimate"))


_VERSIONED = f"""{GRID}, iv as (select model_key, effective_date, lead(effective_date) over (partition by model_key order by effective_date) as nxt, row_number() over (partition by model_key order by effective_date) as i from versions),
mv as (select model_key, month, effective_date from iv, (select distinct month from g) where (month >= effective_date or i = 1) and (nxt is null or month < nxt)),
mr as (select model_key, month, sum(weight * r) / sum(case when r is not null then weight end) as r, coalesce(sum(case when r is not null then weight end), 0) / sum(weight) as coverage
  from mv join version_holdings using (model_key, effective_date) join rt on instrument = symbol and rt.month = mv.month group by model_key, mv.month as month)""".replace("group by model_key, mv.month as month", "group by model_key, mv.month").replace("select model_key, month, sum(weight * r)", "select model_key, mv.month as month, sum(weight * r)")


def version_of_month(t: Tables, months: DataFrame) -> DataFrame:
    """(model_key, month, effective_date): the version in force on a month's first day; before the first one, the first."""
    w = Window.partitionBy("model_key").orderBy("effective_date")
    v = t.versions.withColumns({"nxt": F.lead("effective_date").over(w), "i": F.row_number().over(w)})
    span = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    # Each version's own months, then an equi-join: the one-row span is the only thing joined without a key.
    start = F.when(F.col("i") == 1, F.col("lo")).otherwise(F.greatest("lo", F.trunc(F.add_months(F.date_sub("effective_date", 1), 1), "month")))
    end = F.least("hi", F.coalesce(F.trunc(F.date_sub("nxt", 1), "month"), F.col("hi")))
    v = v.crossJoin(F.broadcast(span)).withColumns({"start": start, "end": end}).where("start <= end")
    x = v.select("model_key", "effective_date", F.explode(F.sequence("start", "end", F.expr("interval 1 month"))).alias("month"))
    return x.join(months.distinct(), "month").select("model_key", "month", "effective_date")


def model_returns(t: Tables) -> DataFrame:
    r = grid_returns(t)
    held = version_of_month(t, r.select("month")).join(t.version_holdings, ["model_key", "effective_date"])
    x = held.withColumnRenamed("instrument", "symbol").join(r, ["symbol", "month"]).select("model_key", "month", "weight", "r")
    w = F.when(F.col("r").isNotNull(), F.col("weight"))
    return x.groupBy("model_key", "month").agg(F.try_divide(F.sum(F.col("weight") * F.col("r")), F.sum(w)).alias("r"), (F.coalesce(F.sum(w), F.lit(0.0)) / F.sum("weight")).alias("coverage"))


@query("joi11_version_as_of", f"with {_VERSIONED} select model_key, month, effective_date from mv", "price_points versions version_holdings")
def _(t: Tables) -> DataFrame:
    return version_of_month(t, series.month_grid(month_levels(t)).select("month"))


@query("fin03_versioned_returns", f"with {_VERSIONED} select model_key, month, round(r, 8) as r, round(coverage, 8) as coverage from mr", "price_points versions version_holdings")
def _(t: Tables) -> DataFrame:
    return model_returns(t).select("model_key", "month", F.round("r", 8).alias("r"), F.round("coverage", 8).alias("coverage"))


@query("fin04_growth", f"with {_VERSIONED} select model_key, month, round(100 * exp(sum(ln(1 + coalesce(r, 0))) over (partition by model_key order by month)), 6) as growth from mr", "price_points versions version_holdings")
def _(t: Tables) -> DataFrame:
    return series.growth(model_returns(t), ["model_key"]).select("model_key", "month", F.round("growth", 6).alias("growth"))


@query("fin05_period_table", f"""with {_VERSIONED}, k as (select *, row_number() over (partition by model_key order by month desc) as j, max(year(month)) over (partition by model_key) as y from mr where r is not null)
select model_key, count(*) as months, round(exp(sum(ln(1 + r))) - 1, 8) as since_inception, case when count(*) >= 12 then round(exp(sum(case when j <= 12 then ln(1 + r) end)) - 1, 8) end as one_year,
  round(exp(sum(case when year(month) = y then ln(1 + r) end)) - 1, 8) as ytd from k group by model_key""", "price_points versions version_holdings")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("model_key")
    x = model_returns(t).where("r is not null").withColumns({"j": F.row_number().over(w.orderBy(F.desc("month"))), "y": F.max(F.year("month")).over(w)})
    total = lambda c: F.round(F.exp(F.sum(F.when(c, F.log1p("r")))) - 1, 8)
    return x.groupBy("model_key").agg(
        F.count("*").alias("months"), total(F.lit(True)).alias("since_inception"), F.when(F.count("*") >= 12, total(F.col("j") <= 12)).alias("one_year"), total(F.year("month") == F.col("y")).alias("ytd")
    )


@query("fin07_contribution", f"""with {_VERSIONED}, c as (select model_key, instrument, month, weight, r from mv join version_holdings using (model_key, effective_date) join rt on symbol = instrument and rt.month = mv.month
  where effective_date = (select max(effective_date) from versions v where v.model_key = mv.model_key))
select model_key, instrument, round(sum(weight * r), 8) as contribution, round(exp(sum(ln(1 + r))) - 1, 8) as own_return from c group by 1, 2""".replace("select model_key, instrument, month, weight, r", "select model_key, instrument, mv.month, weight, r"), "price_points versions version_holdings")
def _(t: Tables) -> DataFrame:
    r = grid_returns(t)
    last = t.versions.groupBy("model_key").agg(F.max("effective_date").alias("effective_date"))
    v = version_of_month(t, r.select("month")).join(last, ["model_key", "effective_date"], "left_semi").join(t.version_holdings, ["model_key", "effective_date"])
    x = v.withColumnRenamed("instrument", "symbol").join(r, ["symbol", "month"]).withColumnRenamed("symbol", "instrument")
    return x.groupBy("model_key", "instrument").agg(F.round(F.sum(F.col("weight") * F.col("r")), 8).alias("contribution"), F.round(F.exp(F.sum(F.log1p("r"))) - 1, 8).alias("own_return"))


_ATTR = f"""{_VERSIONED}, pv as (select model_key, effective_date, lag(effective_date) over (partition by model_key order by effective_date) as prior from versions),
b as (select mv.model_key, mv.effective_date, mv.month, 'new' as side, weight, r from mv join pv using (model_key, effective_date) join version_holdings h on h.model_key = mv.model_key and h.effective_date = mv.effective_date join rt on symbol = instrument and rt.month = mv.month where prior is not null
  union all select mv.model_key, mv.effective_date, mv.month, 'old', weight, r from mv join pv using (model_key, effective_date) join version_holdings h on h.model_key = mv.model_key and h.effective_date = prior join rt on symbol = instrument and rt.month = mv.month),
s as (select model_key, effective_date, month, side, sum(weight * r) / sum(case when r is not null then weight end) as r from b group by all),
z as (select model_key, effective_date, exp(sum(case when side = 'new' then ln(1 + coalesce(r, 0)) end)) - 1 as new_return, exp(sum(case when side = 'old' then ln(1 + coalesce(r, 0)) end)) - 1 as old_return from s group by 1, 2)"""


@query("fin06_change_attribution", f"with {_ATTR} select model_key, effective_date, round(new_return, 8) as new_return, round(old_return, 8) as old_return, round(new_return - old_return, 8) as value_added from z", "price_points versions version_holdings")
def _(t: Tables) -> DataFrame:
    r = grid_returns(t)
    prior = t.versions.withColumn("prior", F.lag("effective_date").over(Window.partitionBy("model_key").orderBy("effective_date"))).where("prior is not null")
    mv = version_of_month(t, r.select("month")).join(prior, ["model_key", "effective_date"])
    # Both mixes over the same months: one row per month and side, then one join each to holdings and returns.
    sides = mv.select("model_key", "effective_date", "month", F.explode(F.array(F.struct(F.lit("new").alias("side"), F.col("effective_date").alias("at")), F.struct(F.lit("old").alias("side"), F.col("prior").alias("at")))).alias("s"))
    sides = sides.select("model_key", "effective_date", "month", "s.side", "s.at")
    h = t.version_holdings.select("model_key", F.col("effective_date").alias("at"), F.col("instrument").alias("symbol"), "weight")
    x = sides.join(h, ["model_key", "at"]).join(r, ["symbol", "month"])
    w = F.when(F.col("r").isNotNull(), F.col("weight"))
    x = x.groupBy("model_key", "effective_date", "month", "side").agg(F.try_divide(F.sum(F.col("weight") * F.col("r")), F.sum(w)).alias("r"))
    total = lambda s: F.exp(F.sum(F.when(F.col("side") == s, F.log1p(F.coalesce("r", F.lit(0.0)))))) - 1
    x = x.groupBy("model_key", "effective_date").agg(total("new").alias("new_return"), total("old").alias("old_return"))
    return x.select("model_key", "effective_date", F.round("new_return", 8).alias("new_return"), F.round("old_return", 8).alias("old_return"), F.round(F.col("new_return") - F.col("old_return"), 8).alias("value_added"))


@query("fin14_mu", f"with {GRID} select symbol, round(avg(r) * 12, 8) as mu, count(r) as n from rt where r is not null group by 1 having count(r) >= 3", "price_points")
def _(t: Tables) -> DataFrame:
    return risk.mu_sigma(grid_returns(t))[0].select("symbol", F.round("mu", 8).alias("mu"), "n")


@query("joi14_sigma", f"with {GRID}, x as (select * from rt where r is not null) select a.symbol as a, b.symbol as b, round(coalesce(covar_samp(a.r, b.r), 0) * 12, 8) as cov from x a join x b using (month) where a.symbol <= b.symbol group by 1, 2", "price_points")
def _(t: Tables) -> DataFrame:
    return risk.mu_sigma(grid_returns(t))[1].withColumn("cov", F.round("cov", 8))


def current_members(t: Tables) -> DataFrame:
    last = t.versions.groupBy("model_key").agg(F.max("effective_date").alias("effective_date"))
    return t.version_holdings.join(last, ["model_key", "effective_date"]).select("model_key", F.col("instrument").alias("symbol"), "weight")


@query("fin15_max_sharpe")
def _(t: Tables) -> DataFrame:
    return risk.max_sharpe(grid_returns(t), current_members(t))


@query("fin16_optimize")
def _(t: Tables) -> DataFrame:
    """Caps by asset: half of the portfolio for symbols that begin with a letter up to M, a fifth for the others."""
    cap = F.when(F.col("symbol") < "N", 0.5).otherwise(0.2)
    return risk.optimize(grid_returns(t), current_members(t).withColumn("cap", cap))


@query("fin16_optimize_stats")
def _(t: Tables) -> DataFrame:
    cap = F.when(F.col("symbol") < "N", 0.5).otherwise(0.2)
    return risk.optimize(grid_returns(t), current_members(t).withColumn("cap", cap), stats=True)


@query("fin22_periods", f"""with {MONTHS}, s as (select symbol, month, lag(month) over (partition by symbol order by month) as pm from me), u as (select symbol, month, year(month) * 12 + month(month) - row_number() over (partition by symbol order by month) as k from s where pm = month - interval 1 month),
r as (select symbol, count(*) as months from u group by symbol, k qualify row_number() over (partition by symbol order by max(month) desc) = 1)
select symbol, months, list_filter([case when months >= 12 then '1y' end, case when months >= 36 then '3y' end, case when months >= 60 then '5y' end, case when months >= 2 then 'max' end], lambda p: p is not null) as available,
  case when months >= 36 then '3y' when months >= 60 then '5y' when months >= 12 then '1y' when months >= 2 then 'max' end as period from r""", "price_points")
def _(t: Tables) -> DataFrame:
    run = series.latest_run(series.strict_returns(month_levels(t)))
    return run.select("symbol", F.col("n").alias("months"), series.available_periods(F.col("n")).alias("available"), series.resolved_period(F.col("n")).alias("period"))


@query("set04_common_months", f"with {MONTHS} select month from me group by month having count(*) = (select count(distinct symbol) from me)", "price_points")
def _(t: Tables) -> DataFrame:
    me = month_levels(t)
    n = me.select(F.countDistinct("symbol").alias("n"))
    return me.groupBy("month").agg(F.count("*").alias("m")).join(n, F.col("m") == F.col("n")).select("month")


@query("agg30_first_added", "select model_key, instrument, min(effective_date) as first_added from version_holdings group by 1, 2", "version_holdings")
def _(t: Tables) -> DataFrame:
    return t.version_holdings.groupBy("model_key", "instrument").agg(F.min("effective_date").alias("first_added"))


@query("win13_last_12_months", f"with {MONTHS} select symbol, month, level from me qualify row_number() over (partition by symbol order by month desc) <= 12", "price_points")
def _(t: Tables) -> DataFrame:
    me = series.month_end(t.price_points)
    return me.withColumn("j", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("month")))).where("j <= 12").drop("j")


@query("dat03_last_complete_month", "select symbol, date, cast(case when date >= last_day(date) then date_trunc('month', date) else date_trunc('month', date) - interval 1 month end as date) as month from daily_points", "daily_points")
def _(t: Tables) -> DataFrame:
    return t.daily_points.select("symbol", "date", series.last_complete_month(F.col("date")).alias("month"))


def _side_sql(bk: str) -> str:
    """The risk of a book with other weights."""
    own = "bk as (select symbol, (n + 1 - i) / (n * (n + 1) / 2.0::double) as weight from sy)"
    return _RISK.replace(own, f"bk as ({bk})")


@query("fin13_deltas", f"with b as ({_RISK}), p as ({_side_sql('select symbol, 1 / n::double as weight from sy')}) " + " union all ".join(f"select '{m}' as measure, b.{m} as baseline, p.{m} as proposed, round(p.{m} - b.{m}, 7) as delta from b, p" for m in risk.COMPARED), "price_points")
def _(t: Tables) -> DataFrame:
    """The book against one of equal weights, all measures with the benchmark."""
    weights, bench = book(t)
    equal = weights.select("symbol", (1 / F.count("*").over(Window.partitionBy())).alias("weight"))
    sides = weights.withColumn("side", F.lit("baseline")).unionByName(equal.withColumn("side", F.lit("proposed")))
    r = grid_returns(t)
    b = series.blend(r, bench).select("month", F.col("r").alias("b"))
    joined = series.blend(r, sides, by=["side"]).join(b, "month", "left").select("side", "month", "r", "b")
    return risk.static_deltas(risk.risk_metrics(joined, ["side"])).withColumn("delta", F.round("delta", 7))


@query("fin13_coverage", f"with {GRID}, w as (select n_name as symbol, 0.5 + n_nationkey::double as weight from nation union all select 'NONE', 10.0), c as (select w.*, symbol in (select symbol from rt where r is not null) as covered from w) select *, round(sum(weight) filter (covered) over () / sum(weight) over (), 9) as coverage from c", "price_points")
def _(t: Tables) -> DataFrame:
    weights = t.nation.select(F.col("n_name").alias("symbol"), (F.lit(0.5) + F.col("n_nationkey")).alias("weight")).unionByName(t.spark.sql("select 'NONE' as symbol, double(10) as weight"))
    return risk.projection_coverage(weights, grid_returns(t)).withColumn("coverage", F.round("coverage", 9))
