"""Operators on small inputs with values worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as x
from tallyframe.operators import disclosures, extract, holdings, names, ranks, risk, series, writes
from tallyframe.streaming import alerts

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def points(spark, values):
    return spark.createDataFrame(values, "symbol string, date date, close double")


def test_forward_fill_and_returns_keep_gaps_apart(spark):
    p = points(spark, [("a", D(2024, 1, 5), 10.0), ("a", D(2024, 1, 31), 20.0), ("a", D(2024, 3, 1), 30.0), ("b", D(2024, 2, 1), 5.0)])
    levels = series.month_end(p)
    filled = rows(series.levels_on_grid(levels), "symbol", "month")
    assert [r[2] for r in filled] == [20.0, 20.0, 30.0, None, 5.0, 5.0]
    r = rows(series.monthly_returns(series.levels_on_grid(levels)), "symbol", "month")
    assert [v[3] for v in r] == [None, 0.0, 0.5, None, None, 0.0]
    assert series.strict_returns(levels).count() == 0


def test_as_of_never_looks_ahead(spark):
    p = points(spark, [("a", D(2024, 1, 5), 1.0), ("a", D(2024, 1, 9), 2.0)])
    asks = spark.createDataFrame([("a", D(2024, 1, 4)), ("a", D(2024, 1, 5)), ("a", D(2024, 1, 8)), ("a", D(2024, 2, 1)), ("z", D(2024, 1, 1))], "symbol string, ask date")
    got = rows(series.as_of(asks, p, "ask", "date", "close"), "symbol", "ask")
    assert [g[3] for g in got] == [None, 1.0, 1.0, 2.0, None]


def test_latest_run_is_not_the_longest(spark):
    months = spark.createDataFrame([("a", D(2024, m, 1)) for m in (1, 2, 3, 4, 7, 8)], "symbol string, month date")
    assert rows(series.latest_run(months), "symbol") == [("a", D(2024, 7, 1), D(2024, 8, 1), 2)]


def test_windows_clamp_leap_days(spark):
    got = spark.range(1).select(F.explode(series.window_starts(F.lit("2024-02-29").cast("date"))).alias("w")).select("w.*").collect()
    starts = {r.label: r.start for r in got}
    assert starts["1Y"] == D(2023, 2, 28) and starts["YTD"] == D(2023, 12, 31) and starts["QTD"] == D(2023, 12, 31)


def test_risk_against_plain_formulas(spark):
    r, b = [0.02, -0.01, 0.03, 0.00, -0.04, 0.05], [0.01, -0.02, 0.02, 0.01, -0.03, None]
    df = spark.createDataFrame([(D(2024, i + 1, 1), a, c) for i, (a, c) in enumerate(zip(r, b))], "month date, r double, b double")
    got = risk.risk_metrics(df, []).first()
    a, c = np.array(r), np.array(b[:5])
    assert got.n == 6 and math.isclose(got.volatility, a.std(ddof=1) * 12**0.5, abs_tol=1e-7)
    assert math.isclose(got.ann_return, np.prod(1 + a) ** 2 - 1, abs_tol=1e-7)
    assert math.isclose(got.beta, np.cov(a[:5], c)[0, 1] / c.var(ddof=1), abs_tol=1e-7)
    level = np.cumprod(1 + a)
    assert math.isclose(got.max_drawdown, (level / np.maximum(1, np.maximum.accumulate(level)) - 1).min(), abs_tol=1e-7)


def test_risk_ratios_are_null_without_a_divisor(spark):
    df = spark.createDataFrame([(D(2024, i, 1), 0.01, 0.02) for i in range(1, 4)], "month date, r double, b double")
    got = risk.risk_metrics(df, []).first()
    assert got.sharpe is None and got.beta is None and got.info_ratio is None
    # Without a beta alpha counts it as 0; no falling month, so no ratio of falls.
    assert math.isclose(got.alpha, 12 * (0.01 - (1.04 ** (1 / 12) - 1)), abs_tol=1e-7) and got.down_capture is None
    assert math.isclose(got.up_capture, (1.01**3 - 1) / (1.02**3 - 1), abs_tol=1e-7)
    one = risk.risk_metrics(df.limit(1), []).first()
    assert one.volatility == 0 and one.bench_return is None and one.alpha is None and one.up_capture is None


def test_frank_wolfe_beats_equal_weights():
    mu, sigma = np.array([0.10, 0.06, 0.02]), np.diag([0.04, 0.02, 0.01])
    w = risk.frank_wolfe(mu, sigma, np.full(3, 0.6))
    ratio = lambda v: (mu - 0.04) @ v / np.sqrt(v @ sigma @ v)
    assert w.min() >= -1e-9 and w.max() <= 0.6 + 1e-9 and w.sum() <= 1 + 1e-9 and ratio(w) > ratio(np.ones(3) / 3)


def test_breach_rule_on_a_stream_equals_the_replay(spark, tmp_path):
    seq = [0.0, -0.11, -0.12, -0.09, -0.10, -0.07, -0.11, 0.0]
    data = [(k, dt.datetime(2024, 1, i + 1), d) for k in "ab" for i, d in enumerate(seq)]
    df = spark.createDataFrame(data, "key string, ts timestamp, drawdown double")
    want = rows(alerts.replay(df, 0.10), "key", "ts")
    assert [w[3] for w in want[:8]] == ["none", "open", "update", "update", "update", "recover", "open", "recover"]
    src = str(tmp_path / "in")
    df.where("ts < '2024-01-05'").coalesce(1).write.parquet(src)
    out = lambda: (
        alerts.monitor(spark.readStream.schema(df.schema).parquet(src), 0.10).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    )
    out()
    df.where("ts >= '2024-01-05'").coalesce(1).write.mode("append").parquet(src)
    out()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "key", "ts")
    assert [(g[0], g[3], g[4]) for g in got] == [(w[0], w[3], w[4]) for w in want]


def test_event_windows_on_a_stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = alerts.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").select("start", "event_type", "n").collect())) == sorted(map(tuple, alerts.event_windows(src).select("start", "event_type", "n").collect()))


def test_notify_once(spark, tmp_path):
    path = str(tmp_path / "sent")
    first = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert sorted(r.id for r in alerts.notify_once(first, 0, path).collect()) == [1, 2]
    assert sorted(r.id for r in alerts.notify_once(first, 0, path).collect()) == [1, 2]  # the same batch, tried again
    again = alerts.notify_once(spark.createDataFrame([(2,), (3,)], "id int"), 1, path)
    assert [r.id for r in again.collect()] == [3]
    assert alerts.notify_once(first, 2, path).count() == 0


def test_recovery_lies_above_the_band(spark):
    assert alerts.step(True, 1, -0.08, 0.10) == (True, 1, "update")
    assert alerts.step(True, 1, -0.0799, 0.10) == (False, 1, "recover")
    assert alerts.step(False, 1, -0.10, 0.10) == (True, 2, "open")
    assert alerts.step(True, 1, 0.0, 0.01) == (False, 1, "recover") and alerts.step(True, 1, -0.005, 0.01) == (True, 1, "update")
    assert alerts.step(True, 1, None, 0.10) == (True, 1, "update")
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, i + 1), d) for i, d in enumerate([-0.10, -0.08, None, -0.0799])], "key string, ts timestamp, drawdown double")
    assert [r.action for r in alerts.replay(df, 0.10).orderBy("ts").collect()] == ["open", "update", "update", "recover"]


def test_percents_add_up(spark):
    df = spark.createDataFrame([("m", c, w) for c, w in zip("abc", (1.0, 1.0, 1.0))], "k string, item string, w double")
    assert rows(holdings.percent_slices(df, ["k"], "w", "item").select("item", "pct"), "item") == [("a", 33.4), ("b", 33.3), ("c", 33.3)]
    units = rows(holdings.largest_remainder(df, ["k"], "w", 100, "item").select("item", "units"), "item")
    assert units == [("a", 34), ("b", 33), ("c", 33)]


def test_equal_amounts_stay_together(spark):
    df = spark.createDataFrame([("k", f"i{n:02d}", a) for n, a in enumerate([9] * 11 + [5] * 7)], "k string, item string, amount int")
    got = {r.slice: r.total for r in holdings.tie_slices(df, ["k"], "amount").collect()}
    # Eleven are named; seven more would pass the limit of 16, so they are one slice, the twelfth.
    assert len(got) == 12 and got["Equal at 5"] == 35
    more = spark.createDataFrame([("k", f"i{n:02d}", a) for n, a in enumerate([9] * 20 + [7] * 3 + [5] * 12 + [3])], "k string, item string, amount int")
    got = {r.slice: (r.n, r.total) for r in holdings.tie_slices(more, ["k"], "amount").collect()}
    assert got["Equal at 9"] == (20, 180) and {f"i{n}" for n in (20, 21, 22)} < set(got) and "i23" in got and got["Other"] == (1, 3) and len(got) == 17


def test_unknown_amounts_are_left_out_of_dollars(spark):
    t = spark.createDataFrame(
        [("x", "buy", "$1,001 - $15,000"), ("x", "buy", None), ("x", "sell", "Over $50,000,000")], "ticker string, tx_type string, amount_range string"
    )
    got = disclosures.nets(t, ["ticker"]).first()
    assert (got.buys, got.sells, got.net_count, got.excluded, got.minimum) == (2, 1, 1, 1, True) and got.net_estimate == 8000.5 - 50000001


def test_tickers_dates_and_classes(spark):
    one = spark.createDataFrame([(" brk/b ", "Feb 30, 2024", "XYZ common stock")], "t string, d string, c string")
    got = one.select(x.canonical_ticker(F.col("t")), x.loose_date(F.col("d")), x.asset_class(F.col("c")), x.compact_dollars(F.lit(-1250000.0))).first()
    assert tuple(got) == ("BRK.B", None, "stock", "-$1.3M")  # halves go away from zero


def test_close_spellings_need_a_clear_lead(spark):
    cat = spark.createDataFrame([("Alpha Industries Inc", "AAA", "NYSE"), ("Alpha Industriez Inc", "AAB", "NYSE"), ("Omega Semiconductor Corp", "OMG", "Nasdaq")], "name string, ticker string, exchange string")
    nm = spark.createDataFrame([(1, "Alpha Industriee"), (2, "Omega Semiconducter"), (3, "Omega Semiconductor"), (4, "Zeta")], "id int, name string")
    got = {r.id: (r.ticker, r.stage) for r in names.match_names(nm, cat).collect()}
    assert got == {1: (None, "none"), 2: ("OMG", "fuzzy"), 3: ("OMG", "exact"), 4: (None, "none")}


def test_unread_amount_lines_make_a_filing_unreliable(spark):
    df = spark.createDataFrame([(1, "1 ACME Purchase 3/9/2024 No $1,001 - $15,000\n2 ACME ourchasc $15,001"), (2, "1 B Sale 1/2/2024 Yes Over $50,000,000")], "id int, text string")
    assert [(r.id, r.reliable) for r in extract.numbered_trades(df).orderBy("id").collect()] == [(1, False), (2, True)]


def test_wrapped_rows_are_read(spark):
    text = "Filer: A\n1 ACME CORP Purchase\n3/9/2024 No $1,001 -\n$15,000\nPage 1\n2 BETA Sale 3/10/2024 Yes Over $50,000,000\n\nnotes without a number"
    got = rows(extract.numbered_trades(spark.createDataFrame([(1, text)], "id int, text string")), "row")
    assert [g[1:4] + g[5:] for g in got] == [(1, "ACME CORP", "purchase", "$1,001 - $15,000", True), (2, "BETA", "sale", "Over $50,000,000", True)]
    lost = spark.createDataFrame([(1, text + "\n$15,001 - $50,000")], "id int, text string")
    assert {r.reliable for r in extract.numbered_trades(lost).collect()} == {False}


def test_alike_names_share_a_piece(spark):
    base = "alpha industries of the north"
    other = ["alpha industriez of the north", "alpha industries of the nort", "xlpha industries of the north", "alpha 1ndustries of the nor h", "alpha something else entirely"]
    stems = spark.createDataFrame([(base, "alpha")], "stem string, head string")
    index = spark.createDataFrame([(o, o.split()[0], str(i)) for i, o in enumerate(other)], "other string, head string, ticker string")
    got = {r.other for r in names.shared_pieces(stems, index, 0.94).collect()}
    assert other[0] in got and other[1] in got and other[2] not in got and other[4] not in got


def test_upsert_last_incoming_wins(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 3)], "k int, v string, ord long")
    assert rows(writes.upsert(stored, new, ["k"]), "k") == [(1, "a"), (2, "d"), (3, None)]
    assert rows(writes.changed(stored, new, ["k"], "v").select("k", "v"), "k", "v") == [(2, "c"), (2, "d"), (3, None)]


@pytest.mark.parametrize("status,n", [("", 3), ("member", 2), ("candidate", 1)])
def test_missing_status_counts_as_member(spark, status, n):
    df = spark.createDataFrame([("candidate",), ("member",), (None,)], "filer_status string")
    assert df.where(disclosures.by_filer(status)).count() == n


def test_optimized_mix_beats_a_grid_of_mixes():
    import pandas as pd

    r = np.random.default_rng(4)
    months = pd.date_range("2020-01-01", periods=48, freq="MS")
    true = {"a": (0.012, 0.04), "b": (0.008, 0.02), "c": (0.001, 0.05)}
    pdf = pd.DataFrame([("m", s, w, cap, d, m + v * x) for (s, (m, v)), w, cap in zip(true.items(), (0.5, 0.3, 0.1), (0.5, 0.6, 1.0)) for d, x in zip(months, r.standard_normal(48))], columns=["model_key", "symbol", "weight", "cap", "month", "r"])
    short = pd.DataFrame([("m", "d", 0.1, 1.0, months[0], 0.5)], columns=pdf.columns)
    rows, stats = risk._optimize(pd.concat([pdf, short]), 0.04)
    w = dict(zip(rows["symbol"], rows["weight"]))
    assert w["d"] == 0 and not rows.set_index("symbol").loc["d", "usable"] and w["a"] <= 0.5 + 1e-6 and w["b"] <= 0.6 + 1e-6 and sum(w.values()) <= 1 + 1e-6
    now = dict(zip(rows["symbol"], rows["current_weight"]))
    assert math.isclose(now["a"], 0.5 / 0.9, abs_tol=1e-6) and math.isclose(stats["excluded_weight"].iloc[0], 0.1)
    wide = pdf.pivot(index="month", columns="symbol", values="r")
    mu, sigma = wide.mean().to_numpy() * 12, wide.cov().to_numpy() * 12
    grid = [np.array([i, j, k]) / 50 for i in range(26) for j in range(31) for k in range(51) if i + j + k <= 50 and i + j + k > 0]
    best = max((x @ (mu - 0.04)) / np.sqrt(x @ sigma @ x) for x in grid)
    assert stats.set_index("side").loc["optimized", "sharpe"] >= best - 1e-3
    assert stats.set_index("side").loc["optimized", "sharpe"] > stats.set_index("side").loc["current", "sharpe"]


def test_row_numbers_by_ranges(spark):
    r = np.random.default_rng(6)
    data = [(str(g), int(v), i) for i, (g, v) in enumerate(zip(r.integers(0, 3, 300), r.integers(0, 20, 300)))]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(5)
    got = {x.i: x["rank"] for x in ranks.numbered(df, [F.desc("v"), F.col("i")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda t: t[1])] == [i for _, _, i in sorted(data, key=lambda t: (-t[1], t[2]))] and set(got.values()) == set(range(1, 301))
    by = ranks.numbered(df, [F.col("v"), F.col("i")], by=["g"]).collect()
    for g in "012":
        mine = sorted((x for x in by if x.g == g), key=lambda x: x["rank"])
        assert [x.i for x in mine] == [i for _, _, i in sorted((t for t in data if t[0] == g), key=lambda t: (t[1], t[2]))] and [x["rank"] for x in mine] == list(range(1, len(mine) + 1))
