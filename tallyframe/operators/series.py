"""Dated series: month grids, forward fill, returns, as-of look-ups, runs of months and compounding.

A series is long: (symbol, date, value). All operators are windows and aggregates per symbol; a grid has one row
per symbol and month, so it stays small beside the observations it is made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_end(points: DataFrame, value: str = "close", order: str | None = None) -> DataFrame:
    """(symbol, month, level): the last observation of each month; on one date the later row by order."""
    by = F.struct("date", order) if order else F.col("date")
    return points.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by(value, by).alias("level"))


def month_grid(levels: DataFrame) -> DataFrame:
    """(symbol, month): every symbol on every month from the first to the last of all."""
    span = levels.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    # One row per symbol against one per month, both short.
    return levels.select("symbol").distinct().join(months)


def levels_on_grid(levels: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """(symbol, month, level): forward filled; null before the first observation."""
    grid = month_grid(levels) if grid is None else grid
    filled = F.last("level", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(levels, ["symbol", "month"], "left").select("symbol", "month", filled.alias("level"))


def monthly_returns(levels: DataFrame) -> DataFrame:
    """Adds r: null where either level is null or the one before is 0."""
    before = F.lag("level").over(Window.partitionBy("symbol").orderBy("month"))
    return levels.withColumn("r", F.when(before != 0, F.col("level") / before - 1))


def strict_returns(levels: DataFrame) -> DataFrame:
    """(symbol, month, r): only where the month before has an observation of its own; nothing is filled."""
    w = Window.partitionBy("symbol").orderBy("month")
    near = F.lag("month").over(w) == F.add_months("month", -1)
    before = F.lag("level").over(w)
    return levels.select("symbol", "month", F.when(near & (before != 0), F.col("level") / before - 1).alias("r")).where("r is not null")


def blend(returns: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., month, r, coverage): weighted over what has a return; coverage is the share of weight that has."""
    x = returns.join(weights, "symbol")
    w = F.when(F.col("r").isNotNull(), F.col("weight"))
    return x.groupBy(*(by or []), "month").agg(
        F.try_divide(F.sum(F.col("weight") * F.col("r")), F.sum(w)).alias("r"),
        F.try_divide(F.coalesce(F.sum(w), F.lit(0.0)), F.sum("weight")).alias("coverage"),
    )


def compounded(r: Column) -> Column:
    """Product of 1 + r, minus 1, as an aggregate; a null month counts as 0."""
    return F.exp(F.sum(F.log1p(F.coalesce(r, F.lit(0.0))))) - 1


def growth(returns: DataFrame, by: list[str], basis: float = 100.0) -> DataFrame:
    """Adds growth of the basis by the end of each month."""
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("growth", F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(w)) * basis)


def as_of(left: DataFrame, right: DataFrame, left_date: str, right_date: str, value: str) -> DataFrame:
    """left with the last value of right on or before left_date, per symbol, without a range join.

    Both sides go into one sorted run per symbol and the last value is carried along: one shuffle, linear work.
    """
    names = left.columns
    a = left.withColumns({"_t": F.col(left_date), "_v": F.lit(None).cast(right.schema[value].dataType), "_d": F.lit(None).cast("date"), "_o": F.lit(1)})
    b = right.select("symbol", F.col(right_date).alias("_t"), F.col(value).alias("_v"), F.col(right_date).alias("_d"), F.lit(0).alias("_o"))
    w = Window.partitionBy("symbol").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumns({"asof_value": F.last("_v", ignorenulls=True).over(w), "asof_date": F.last("_d", ignorenulls=True).over(w)})
    return both.where("_o = 1").select(*names, "asof_date", "asof_value")


def runs_of_months(months: DataFrame) -> DataFrame:
    """(symbol, first, last, n): maximal runs of consecutive months."""
    index = F.year("month") * 12 + F.month("month")
    run = index - F.row_number().over(Window.partitionBy("symbol").orderBy("month"))
    x = months.select("symbol", "month").distinct().withColumn("run", run)
    return x.groupBy("symbol", "run").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n")).drop("run")


def latest_run(months: DataFrame) -> DataFrame:
    """The run with the latest month, per symbol (not the longest)."""
    r = runs_of_months(months)
    return r.groupBy("symbol").agg(F.max_by(F.struct("first_month", "last_month", "n"), "last_month").alias("r")).select("symbol", "r.*")


def trailing_peak(points: DataFrame, days: int = 364) -> DataFrame:
    """(symbol, n, first_date, last_date, last_close, peak_date, peak_close, drawdown, covers): peak over the days up to the last point.

    On equal peaks the later date wins. covers: the series reaches back over the whole window.
    """
    good = points.where("close > 0")
    last = F.max("date").over(Window.partitionBy("symbol"))
    x = good.withColumn("_last", last).groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"),
        F.max(F.when(F.col("date") >= F.date_sub("_last", days), F.struct("close", "date"))).alias("peak"),
    )
    return x.select(
        "symbol", "n", "first_date", "last_date", "last_close", F.col("peak.date").alias("peak_date"), F.col("peak.close").alias("peak_close"),
        (F.col("last_close") / F.col("peak.close") - 1).alias("drawdown"), (F.col("first_date") <= F.date_sub("last_date", days)).alias("covers"),
    )


def last_complete_month(as_of: Column) -> Column:
    """First day of the last month that is over (or ends) on a date."""
    return F.when(as_of >= F.last_day(as_of), F.trunc(as_of, "month")).otherwise(F.add_months(F.trunc(as_of, "month"), -1))


TRADING_DAYS = 252
THIN_FROM = 3


def window_starts(as_of: Column) -> Column:
    """Starts of the standard windows of a date, as an array of (label, start)."""
    first = lambda unit: F.date_sub(F.trunc(as_of, unit), 1)
    back = lambda m: F.add_months(as_of, -m)
    parts = [("MTD", first("month")), ("QTD", first("quarter")), ("YTD", first("year")), *((f"{y}Y", back(12 * y)) for y in (1, 3, 5, 10, 15, 20))]
    return F.array(*[F.struct(F.lit(a).alias("label"), b.alias("start")) for a, b in parts])


def period_returns(points: DataFrame, as_of_dates: DataFrame) -> DataFrame:
    """(symbol, label, start, base_date, end_date, ret, annualized, estimate): as-of level at both ends; null where the series starts later.

    as_of_dates: (symbol, as_of). Windows of three years and more are annualised by their real span (and ret is their total
    return). A window is an estimate where it has under 90 % of the trading days that its span makes expect.
    """
    asked = as_of_dates.select("symbol", "as_of", F.explode(window_starts(F.col("as_of"))).alias("w")).select("symbol", "as_of", "w.label", "w.start")
    start = as_of(asked, points, "start", "date", "close").withColumnsRenamed({"asof_date": "base_date", "asof_value": "base"})
    end = as_of(start, points, "as_of", "date", "close").withColumnsRenamed({"asof_date": "end_date", "asof_value": "top"})
    ret = F.when((F.col("base") != 0) & (F.col("end_date") > F.col("base_date")), F.col("top") / F.col("base") - 1)
    years = F.datediff("end_date", "base_date") / 365.25
    long = F.col("label").isin("3Y", "5Y", "10Y", "15Y", "20Y") & (1 + ret >= 0)
    # The places of both ends in the series give the number of points between them.
    nth = points.select("symbol", F.col("date").alias("d"), F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("nth"))
    for name, date in (("i", "base_date"), ("j", "end_date")):
        end = end.join(nth.select("symbol", F.col("d").alias(date), F.col("nth").alias(name)), ["symbol", date], "left")
    expected = F.datediff("end_date", "base_date") * (TRADING_DAYS / 365.25)
    thin = F.when(ret.isNotNull(), (expected >= THIN_FROM) & (F.col("j") - F.col("i") < 0.9 * expected))
    return end.select("symbol", "label", "start", "base_date", "end_date", ret.alias("ret"), F.when(long, F.pow(1 + ret, 1 / years) - 1).alias("annualized"), thin.alias("estimate"))


PERIODS = (("1y", 12), ("3y", 36), ("5y", 60), ("max", 2))


def available_periods(months: Column) -> Column:
    """The periods that a run of so many months covers."""
    return F.array_compact(F.array(*[F.when(months >= n, p) for p, n in PERIODS]))


def resolved_period(months: Column, asked: str | None = None) -> Column:
    """The asked period if it is covered, else null; without one three years, else five, one, or all there is."""
    if asked:
        if asked not in dict(PERIODS):
            raise ValueError(f"period must be one of {', '.join(dict(PERIODS))}")
        return F.when(months >= dict(PERIODS)[asked], asked)
    return F.coalesce(*[F.when(months >= dict(PERIODS)[p], p) for p in ("3y", "5y", "1y", "max")])


def sparkline(points: DataFrame, n: int = 40) -> DataFrame:
    """n evenly spaced points of each series (all of a shorter one)."""
    w = Window.partitionBy("symbol")
    x = points.withColumns({"i": (F.row_number().over(w.orderBy("date")) - 1).cast("long"), "m": F.count("*").over(w)})
    # Index i is chosen when some k of 0..n-1 rounds to it.
    k = F.ceil((F.col("i") - 0.5) * (n - 1) / (F.col("m") - 1))
    chosen = (F.col("m") <= n) | (F.floor(k * (F.col("m") - 1) / (n - 1) + 0.5) == F.col("i"))
    return x.where(chosen).select("symbol", "i", "date", "close")


def sudden_moves(points: DataFrame, limit: float = 0.4, gap: int = 5) -> DataFrame:
    """Moves of more than limit between neighbours that are at most gap days apart."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = points.select("symbol", "date", "close", F.lag("close").over(w).alias("before"), F.datediff("date", F.lag("date").over(w)).cast("long").alias("days"))
    return x.where((F.col("before") > 0) & (F.col("days") <= gap) & (F.abs(F.col("close") / F.col("before") - 1) > limit))
