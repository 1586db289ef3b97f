"""Scans, filters, joins and orders in their plain forms, and a few reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import disclosures, ranks, risk, series
from ..sources import files
from ..sources.tables import Tables
from .registry import query
from .series import _VERSIONED, BOOK, GRID, MONTHS, book, grid_returns, model_returns


@query("src01_scan", "select * from supplier")
def _(t: Tables) -> DataFrame:
    return t.supplier


@query("src02_narrow_scan", "select p_partkey, p_brand from part where p_size > 40")
def _(t: Tables) -> DataFrame:
    return t.part.where("p_size > 40").select("p_partkey", "p_brand")


@query("src06_json_series", "select n_nationkey as id, 0::bigint as pos, '2024-01-01' as date, n_regionkey + 0.5::double as level from nation union all select n_nationkey, 1, '2024-01-02', n_nationkey::double from nation")
def _(t: Tables) -> DataFrame:
    doc = F.concat(F.lit('[{"date":"2024-01-01","close":'), (F.col("n_regionkey") + F.lit(0.5)).cast("string"), F.lit('},{"date":"2024-01-02","nav":'), F.col("n_nationkey").cast("string"), F.lit("}]"))
    x = t.nation.select(F.col("n_nationkey").alias("id"), files.unnest_series(doc).alias("pos", "p"))
    return x.select("id", F.col("pos").cast("long").alias("pos"), F.col("p.date").alias("date"), F.coalesce("p.price", "p.value", "p.close", "p.nav").alias("level"))


@query("src07_array_unnest", "select o_custkey, unnest(list(o_orderkey order by o_orderkey)) as o_orderkey, unnest(list(o_totalprice order by o_orderkey)) as o_totalprice from orders group by 1")
def _(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    return a.select("o_custkey", F.inline("a"))


@query("src11_chart_points", "select n_nationkey as id, timestamp '1970-01-01 00:00:00' + to_seconds(86400 * (n_nationkey + 1)) as ts, case when n_nationkey % 2 = 0 then 2.5::double else 1.5::double end as value from nation")
def _(t: Tables) -> DataFrame:
    doc = F.concat(F.lit('{"timestamp":['), ((F.col("n_nationkey") + 1) * 86400).cast("string"), F.lit('],"close":[1.5],"adjclose":['), F.when(F.col("n_nationkey") % 2 == 0, "2.5").otherwise("null"), F.lit("]}"))
    x = t.nation.select(F.col("n_nationkey").alias("id"), F.inline(files.chart_points(doc)))
    return x.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("src20_first_source", "with u as (select c_custkey as k, 2 as rank, 'b' as src from customer where c_custkey % 2 = 0 union all select c_custkey, 1, 'a' from customer where c_custkey % 3 = 0) select k, arg_min(src, rank) as src, min(rank) as rank from u group by 1")
def _(t: Tables) -> DataFrame:
    c = t.customer
    u = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(2).alias("rank"), F.lit("b").alias("src")).unionByName(c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("rank"), F.lit("a").alias("src")))
    return files.first_source(u, ["k"], "rank")


@query("fil04_date_window", "select o_orderkey from orders where cast(o_orderdate as date) between date '1997-01-01' and date '1997-03-31'")
def _(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderdate") >= "1997-01-01") & (F.col("o_orderdate") < "1997-04-01")).select("o_orderkey")


@query("fil08_any_of", "select s_suppkey, s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def _(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation.where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query("fil10_pattern", "select p_partkey from part where regexp_matches(p_brand, '^Brand#[1-3][1-4]$')")
def _(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_brand").rlike("^Brand#[1-3][1-4]$")).select("p_partkey")


@query("fil13_stale_rows", "select filing_id from filings where parse_status <> 'parsed' and (filer_status is null or filed_date < date '1997-01-01')", "filings")
def _(t: Tables) -> DataFrame:
    return t.filings.where((F.col("parse_status") != "parsed") & (F.col("filer_status").isNull() | (F.col("filed_date") < "1997-01-01"))).select("filing_id")


@query("joi04_left_metadata", "select n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey and r_regionkey < 3")
def _(t: Tables) -> DataFrame:
    return t.nation.join(t.region.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


@query("joi05_lateral_top1", "select c_custkey, o.o_orderkey, o.o_totalprice from customer, lateral (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) o")
def _(t: Tables) -> DataFrame:
    top = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o"))
    return top.select(F.col("o_custkey").alias("c_custkey"), "o.*")


@query("joi06_share_of_total", "select o_orderpriority, n, round(n / total::double, 8) as share from (select o_orderpriority, count(*) as n from orders group by 1), (select count(*) as total from orders)")
def _(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(t.orders.agg(F.count("*").alias("total")))).select("o_orderpriority", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))  # one row each side of a total


@query("joi09_correlated_counts", "select c_custkey, (select max(cast(o_orderdate as date)) from orders where o_custkey = c_custkey) as newest, (select count(*) from orders where o_custkey = c_custkey) as n from customer")
def _(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("newest"), F.count("*").alias("n"))
    return t.customer.join(g, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "newest", F.coalesce("n", F.lit(0)).alias("n"))


@query("joi21_latest_price_enrichment", "select n_nationkey, n_name, close, date from nation left join (select symbol, max(date) as date, arg_max(close, date) as close from price_points group by 1) on symbol = n_name", "price_points")
def _(t: Tables) -> DataFrame:
    p = t.price_points.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    return t.nation.join(p, F.col("n_name") == F.col("symbol"), "left").select("n_nationkey", "n_name", "close", "date")


@query("win01_rank_in_side", "select l_returnflag, l_partkey, n, row_number() over (partition by l_returnflag order by n desc, l_partkey) as rank from (select l_returnflag, l_partkey, count(*) as n from lineitem group by 1, 2) qualify rank <= 10")
def _(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "l_partkey")).cast("long")).where("rank <= 10")


@query("win03_first_per_group", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def _(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return g.select("o_custkey", "o.*")


@query("win10_running_sum", "select c_nationkey, c_custkey, (sum(cast(c_acctbal as decimal(18,2))) over (partition by c_nationkey order by c_custkey))::double as running from customer")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.customer.select("c_nationkey", "c_custkey", F.sum(F.col("c_acctbal").cast("decimal(18,2)")).over(w).cast("double").alias("running"))


@query("win20_side_totals", "select tx_type, ticker, n, (sum(n) over (partition by tx_type))::bigint as total from (select tx_type, ticker, count(*) as n from trades where ticker is not null group by 1, 2)", "trades")
def _(t: Tables) -> DataFrame:
    g = t.trades.where("ticker is not null").groupBy("tx_type", "ticker").agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy("tx_type")))


@query("srt01_multi_key", "select s_suppkey, s_nationkey, s_acctbal from supplier order by s_nationkey desc, s_acctbal, s_suppkey limit 50")
def _(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").orderBy(F.desc("s_nationkey"), "s_acctbal", "s_suppkey").limit(50)


@query("srt07_latest_one", "select symbol, max(date) as date, arg_max(close, date) as close from daily_points group by 1", "daily_points")
def _(t: Tables) -> DataFrame:
    return t.daily_points.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


@query("srt08_work_plan", "select c_custkey, newest from customer left join (select o_custkey, max(o_orderdate) as newest from orders group by 1) on o_custkey = c_custkey order by newest nulls first, c_custkey limit 8")
def _(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))
    return t.customer.join(g, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "newest").orderBy(F.asc_nulls_first("newest"), "c_custkey").limit(8)


@query("agg25_range_totals", "select person_key, count(*) as n, sum(low)::bigint as low, case when count(*) filter (low is not null and high is null) = 0 then sum(high)::bigint end as high, bool_or(low is not null and high is null) as open_ended from bounded group by 1", "bounded")
def _(t: Tables) -> DataFrame:
    x = disclosures.with_bounds(t.trades)
    open_row = F.col("low").isNotNull() & F.col("high").isNull()
    return x.groupBy("person_key").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.when(F.count_if(open_row) == 0, F.sum("high")).alias("high"), F.bool_or(open_row).alias("open_ended"))


@query("agg28_queue_position", "select filing_id, row_number() over (order by filed_date, filing_id) as position, count(*) over () as queued from filings where parse_status = 'needs_manual_review'", "filings")
def _(t: Tables) -> DataFrame:
    q = t.filings.where("parse_status = 'needs_manual_review'")
    placed = ranks.numbered(q.select("filing_id", "filed_date"), ["filed_date", "filing_id"], "position")
    return placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("queued")))).select("filing_id", "position", "queued")  # one row beside each


@query("fin18_since_added", "with a as (select symbol, max(date) - 200 as added from price_points group by 1), b as (select symbol, added, max(date) as base from a join price_points p using (symbol) where date <= added group by 1, 2) select symbol, date, close from price_points join b using (symbol) where date >= base", "price_points")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol")
    x = t.price_points.withColumn("added", F.date_sub(F.max("date").over(w), 200))
    x = x.withColumn("base", F.max(F.when(F.col("date") <= F.col("added"), F.col("date"))).over(w))
    return x.where("date >= base").select("symbol", "date", "close")


@query("fin26_history_complete", f"""with {MONTHS}, s as (select symbol, month, year(month) * 12 + month(month) as i from me), r as (select symbol, count(*) as months, max(i) - min(i) + 1 as span, max(month) as last_month from s group by 1)
select symbol, months, months = span and months >= 24 and last_month >= date '2001-07-01' as complete from r""", "price_points")
def _(t: Tables) -> DataFrame:
    me = series.month_end(t.price_points)
    i = F.year("month") * 12 + F.month("month")
    g = me.groupBy("symbol").agg(F.count("*").alias("months"), (F.max(i) - F.min(i) + 1).alias("span"), F.max("month").alias("last_month"))
    return g.select("symbol", "months", ((F.col("months") == F.col("span")) & (F.col("months") >= 24) & (F.col("last_month") >= "2001-07-01")).alias("complete"))


_TWO = f"""with {GRID}, {BOOK}, p as (select symbol, 1 / count(*) over ()::double as weight from bk), w as (select 'baseline' as side, * from bk union all select 'proposed', * from p),
b as (select side, month, sum(weight * r) / sum(case when r is not null then weight end) as r from rt join w using (symbol) group by 1, 2)
select side, count(r) as n, round(exp(sum(ln(1 + r)) * 12 / count(r)) - 1, 8) as ann_return, round(stddev_samp(r) * sqrt(12::double), 8) as volatility from b where r is not null group by 1"""


@query("fin13_baseline_and_proposed", _TWO, "price_points")
def _(t: Tables) -> DataFrame:
    base = book(t)[0]
    equal = base.select("symbol", (1 / F.count("*").over(Window.partitionBy())).alias("weight"))
    w = base.withColumn("side", F.lit("baseline")).unionByName(equal.withColumn("side", F.lit("proposed")))
    r = series.blend(grid_returns(t), w, by=["side"]).withColumn("b", F.lit(None).cast("double"))
    return risk.risk_metrics(r, ["side"]).select("side", "n", "ann_return", "volatility")


@query("fin21_common_window_risk", f"""with {GRID}, x as (select symbol, month, r from rt where r is not null and true),
c as (select month from x group by 1 having count(*) = (select count(distinct symbol) from x)), k as (select month, year(month) * 12 + month(month) - row_number() over (order by month) as g from c),
l as (select month from k where g = (select max_by(g, month) from k) order by month desc limit 36)
select symbol, count(*) as n, round(exp(sum(ln(1 + r)) * 12 / count(*)) - 1, 8) as ann_return, round(stddev_samp(r) * sqrt(12::double), 8) as volatility from x join l using (month) group by 1""", "price_points")
def _(t: Tables) -> DataFrame:
    """All symbols by their own returns; fin21_model_window_risk runs over the models."""
    r = grid_returns(t).where("r is not null")
    return common_window_risk(r, r.select("symbol").distinct())


@query("fin21_model_window_risk", f"""with {_VERSIONED}, x as (select model_key, month, r from mr join models using (model_key) where r is not null),
c as (select month from x group by 1 having count(*) = (select count(*) from models)), k as (select month, year(month) * 12 + month(month) - row_number() over (order by month) as g from c),
l as (select month from k where g = (select max_by(g, month) from k) order by month desc limit 36)
select model_key, count(*) as n, round(exp(sum(ln(1 + r)) * 12 / count(*)) - 1, 8) as ann_return, round(stddev_samp(r) * sqrt(12::double), 8) as volatility from x join l using (month) group by 1""", "price_points versions version_holdings models")
def _(t: Tables) -> DataFrame:
    """All models, by their versioned monthly returns."""
    names = t.models.select(F.col("model_key").alias("symbol"))
    r = model_returns(t).where("r is not null").select(F.col("model_key").alias("symbol"), "month", "r")
    return common_window_risk(r.join(names, "symbol", "left_semi"), names).withColumnRenamed("symbol", "model_key")


def common_window_risk(x: DataFrame, names: DataFrame) -> DataFrame:
    """Risk of all names on the months that all of them have: the latest unbroken run, its last 36 months at most."""
    n = names.agg(F.count("*").alias("all"))
    common = x.groupBy("month").agg(F.count("*").alias("m")).crossJoin(F.broadcast(n)).where("m = all").select("month", F.lit("").alias("symbol"))
    run = series.latest_run(common).select("first_month", "last_month")
    x = x.join(F.broadcast(run), F.col("month").between(F.greatest("first_month", F.add_months("last_month", -35)), F.col("last_month")))
    return risk.risk_metrics(x.select("symbol", "month", "r", F.lit(None).cast("double").alias("b")), ["symbol"]).select("symbol", "n", "ann_return", "volatility")
