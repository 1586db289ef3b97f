"""Risk of a monthly return series against a benchmark, in one aggregation per book."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def max_drawdown(returns: DataFrame, by: list[str]) -> DataFrame:
    """(by..., max_drawdown): lowest level over its running peak, less 1; the peak starts at 1."""
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    x = returns.withColumn("level", F.exp(F.sum(F.log1p("r")).over(w)))
    x = x.withColumn("peak", F.greatest(F.lit(1.0), F.max("level").over(w)))
    return x.groupBy(*by).agg(F.least(F.lit(0.0), F.min(F.col("level") / F.col("peak") - 1)).alias("max_drawdown"))


def risk_metrics(joint: DataFrame, by: list[str], rf: float = 0.04, decimals: int = 8) -> DataFrame:
    """Fifteen measures of (by..., month, r, b): b, the benchmark's return, may be null.

    Ratios are null where their divisor is 0; measures against the benchmark use months that have both and need two of
    them. Capture ratios compare the compounded returns of months in which the benchmark rose, or fell. Without a beta
    alpha counts it as 0. One month alone has a volatility of 0.
    """
    own = joint.where(F.col("r").isNotNull())
    rf_m = (1 + rf) ** (1 / 12) - 1
    both = F.col("b").isNotNull()
    r, b = F.when(both, F.col("r")), F.col("b")
    logs = lambda c: F.sum(F.log1p(c))
    short = F.least(F.lit(0.0), F.col("r") - rf_m)
    up, down = both & (b > 0), both & (b < 0)
    a = own.groupBy(*by).agg(
        F.count("r").alias("n"), logs(F.col("r")).alias("_g"), F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_sd"),
        F.avg(short * short).alias("_semi"), F.count(r).alias("_nb"), logs(b).alias("_gb"), logs(r).alias("_gj"), F.avg(r).alias("_mr"), F.avg(b).alias("_mb"),
        F.covar_samp(r, b).alias("_cov"), F.var_samp(b).alias("_vb"), F.stddev_samp(r).alias("_sr"), F.stddev_samp(b).alias("_sb"), F.stddev_samp(r - b).alias("_te"),
        *[(F.exp(F.sum(F.when(c, F.log1p(x)))) - 1).alias(k) for k, c, x in (("_ru", up, F.col("r")), ("_bu", up, b), ("_rd", down, F.col("r")), ("_bd", down, b))],
    )
    ratio = lambda x, y: F.when(F.abs(y) > 1e-15, x / y)
    ann, vol, semi = F.exp(F.col("_g") * 12 / F.col("n")) - 1, F.coalesce("_sd", F.lit(0.0)) * 12**0.5, F.sqrt("_semi") * 12**0.5
    two = F.col("_nb") >= 2
    bench = F.when(two, F.exp(F.col("_gb") * 12 / F.col("_nb")) - 1)
    joint_ann = F.when(two, F.exp(F.col("_gj") * 12 / F.col("_nb")) - 1)
    beta, te = ratio(F.col("_cov"), F.col("_vb")), F.col("_te") * 12**0.5
    out = {
        "ann_return": ann, "volatility": vol, "downside": semi, "sharpe": ratio(ann - rf, vol), "sortino": F.when(F.col("n") >= 2, ratio(ann - rf, semi)), "beta": beta,
        "alpha": F.when(two, (F.col("_mr") - rf_m - F.coalesce(beta, F.lit(0.0)) * (F.col("_mb") - rf_m)) * 12), "correlation": ratio(F.col("_cov"), F.col("_sr") * F.col("_sb")), "tracking_error": te,
        "bench_return": bench, "active_return": joint_ann - bench, "info_ratio": ratio(joint_ann - bench, te), "up_capture": F.when(two, ratio(F.col("_ru"), F.col("_bu"))), "down_capture": F.when(two, ratio(F.col("_rd"), F.col("_bd"))),
    }
    a = a.select(*by, "n", *[F.round(c, decimals).alias(k) for k, c in out.items()])
    drawdown = max_drawdown(own, by).withColumn("max_drawdown", F.round("max_drawdown", decimals))
    return a.join(drawdown, by) if by else a.crossJoin(drawdown)  # without keys both have one row


# The measures by which a proposed book is held against the one there is.
COMPARED = ("sharpe", "sortino", "info_ratio", "volatility", "max_drawdown", "beta", "tracking_error", "ann_return")


def static_deltas(metrics: DataFrame) -> DataFrame:
    """(measure, baseline, proposed, delta) of risk_metrics by side, which is baseline or proposed; a delta needs both."""
    long = metrics.select("side", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in COMPARED))).alias("m"))
    one = lambda s: F.max(F.when(F.col("side") == s, F.col("m.v")))
    x = long.groupBy("m.measure").agg(one("baseline").alias("baseline"), one("proposed").alias("proposed"))
    return x.select("measure", "baseline", "proposed", (F.col("proposed") - F.col("baseline")).alias("delta"))


def projection_coverage(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, weight, covered, coverage) of a proposed book: whether a symbol has a monthly return, and the share of all weight that has."""
    from pyspark.sql import Window

    there = returns.where(F.col("r").isNotNull()).select("symbol", F.lit(True).alias("_there")).distinct()
    x = weights.join(there, "symbol", "left").withColumn("covered", F.coalesce("_there", F.lit(False)))
    every = Window.partitionBy()  # a book has a row for each holding
    total = F.sum("weight").over(every)
    share = F.coalesce(F.sum(F.when(F.col("covered"), F.col("weight"))).over(every), F.lit(0.0)) / total
    return x.select("symbol", "weight", "covered", F.when(total > 0, share).otherwise(0.0).alias("coverage"))


def mu_sigma(returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Yearly means (symbol, mu, n) of symbols with three months or more, and pairwise complete covariances (a, b, cov).

    Pairs share months, so the self join is by month: its size is months times symbols squared, as the result needs.
    """
    r = returns.where("r is not null")
    mu = r.groupBy("symbol").agg((F.avg("r") * 12).alias("mu"), F.count("*").alias("n")).where("n >= 3")
    x = r.join(mu.select("symbol"), "symbol", "left_semi")
    a, b = x.select("month", F.col("symbol").alias("a"), F.col("r").alias("ra")), x.select("month", F.col("symbol").alias("b"), F.col("r").alias("rb"))
    cov = a.join(b, "month").where("a <= b").groupBy("a", "b").agg((F.coalesce(F.covar_samp("ra", "rb"), F.lit(0.0)) * 12).alias("cov"))
    return mu, cov


def fill(slope: np.ndarray, caps: np.ndarray, only_gains: bool) -> np.ndarray:
    """Weights up to 1 in sum for the steepest slopes first (of equal ones the earlier), each up to its cap."""
    out, room = np.zeros(len(slope)), 1.0
    for i in np.argsort(-slope, kind="stable"):
        if room <= 1e-12 or (only_gains and slope[i] <= 0):
            break
        out[i] = min(caps[i], room)
        room -= out[i]
    return out


def frank_wolfe(mu: np.ndarray, sigma: np.ndarray, caps: np.ndarray, rf: float = 0.04, steps: int = 1500) -> np.ndarray:
    """Weights of the largest Sharpe ratio under 0 <= w <= caps and sum(w) <= 1; what is left earns rf."""
    w = fill(np.zeros(len(mu)), caps, False)
    for t in range(1, steps + 1):
        excess, pull = (mu - rf) @ w, sigma @ w
        vol = np.sqrt(max(w @ pull, 1e-18))
        slope = (mu - rf) / vol - excess * pull / vol**3
        w = w + 2 / (t + 2) * (fill(slope, caps, True) - w)
    return w


def portfolio_stats(w: np.ndarray, mu: np.ndarray, sigma: np.ndarray, rf: float) -> tuple[float, float, float | None, float]:
    """Expected return (idle cash earns rf), volatility, Sharpe ratio and the share of cash."""
    cash = max(0.0, 1 - w.sum())
    expected, vol = float(w @ mu + rf * cash), float(np.sqrt(max(0.0, w @ sigma @ w)))
    return expected, vol, (expected - rf) / vol if vol > 0 else None, float(cash)


OPTIMIZED = "model_key string, symbol string, weight double, current_weight double, usable boolean"
STATS = "model_key string, side string, expected_return double, volatility double, sharpe double, cash double, excluded_weight double"


def _optimize(pdf: pd.DataFrame, rf: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    key = pdf["model_key"].iloc[0]
    held = pdf.groupby("symbol", sort=True).agg(current=("weight", "first"), cap=("cap", "first"))
    wide = pdf.dropna(subset=["r"]).pivot_table(index="month", columns="symbol", values="r").sort_index(axis=1)
    wide = wide.loc[:, wide.count() >= 3]
    names = list(wide.columns)
    held["usable"] = held.index.isin(names)
    mu, sigma = wide.mean().to_numpy() * 12, wide.cov().fillna(0).to_numpy() * 12
    part = held.loc[names]
    now = part["current"].to_numpy() / (part["current"].sum() or 1.0)
    best = frank_wolfe(mu, sigma, part["cap"].to_numpy(), rf) if names else np.array([])
    held["weight"] = pd.Series(best, index=names, dtype=float)
    rows = pd.DataFrame({
        "model_key": key, "symbol": held.index, "weight": held["weight"].fillna(0.0).round(6).to_numpy(),
        "current_weight": pd.Series(now, index=names, dtype=float).reindex(held.index).fillna(0.0).round(6).to_numpy(), "usable": held["usable"].to_numpy(),
    })
    excluded = float(held.loc[~held["usable"], "current"].sum())
    stats = [(key, side, *portfolio_stats(w, mu, sigma, rf), excluded) for side, w in (("current", now), ("optimized", best))] if names else []
    return rows, pd.DataFrame(stats, columns=[c.split()[0] for c in STATS.split(", ")])


def optimize(returns: DataFrame, members: DataFrame, rf: float = 0.04, stats: bool = False) -> DataFrame:
    """Each model's best mix beside its current one; members: (model_key, symbol, weight, cap), weights of the current mix.

    Symbols with fewer than three months are left out and their weight is reported; the current mix is renormalised to the
    others. One small optimisation per model, each in its own task. With stats: the measures of both mixes instead.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return _optimize(pdf, rf)[1 if stats else 0]

    x = members.join(returns.where("r is not null"), "symbol", "left").select("model_key", "symbol", "weight", "cap", "month", "r")
    return x.groupBy("model_key").applyInPandas(kernel, STATS if stats else OPTIMIZED)


def max_sharpe(returns: DataFrame, members: DataFrame, cap: float = 0.35, rf: float = 0.04) -> DataFrame:
    """(model_key, symbol, weight) of usable symbols, one cap for all; members: (model_key, symbol)."""
    x = members.select("model_key", "symbol").withColumns({"weight": F.lit(1.0), "cap": F.lit(cap)})
    return optimize(returns, x, rf).where("usable").select("model_key", "symbol", "weight")
