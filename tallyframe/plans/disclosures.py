"""Queries on disclosed trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import disclosures as d
from ..operators import ranks
from ..sources.tables import Tables
from .registry import query

AS_OF, DAYS = "1998-06-30", 30
WINDOW = f"w as (select *, case when high is not null then (low + high) / 2.0::double else low::double end as mid from bounded where disclosed_date between date '{AS_OF}' - {DAYS - 1} and date '{AS_OF}')"
NET = """count(*) filter (tx_type = 'buy') as buys, count(*) filter (tx_type = 'sell') as sells, count(*) filter (tx_type = 'buy') - count(*) filter (tx_type = 'sell') as net_count,
  case when count(low) > 0 then coalesce(sum(mid) filter (tx_type = 'buy'), 0) - coalesce(sum(mid) filter (tx_type = 'sell'), 0) end as net_estimate,
  count(*) filter (low is not null and high is null) > 0 as minimum, count(*) filter (low is null) as excluded"""
RANKING = """select tx_type, ticker, count(*) as trades, count(distinct person_key) as people, coalesce(sum(low), 0)::bigint as sum_low, coalesce(sum(high), 0)::bigint as sum_high,
  count(*) filter (low is not null and high is null) as open_rows, count(low) as known, bool_or(asset_class in ('stock', 'etf', 'fund')) as matchable"""


def recent(t: Tables) -> DataFrame:
    return d.in_window(t.trades, AS_OF, DAYS)


@query("agg01_side_ranking", f"""with {WINDOW}, g as ({RANKING} from w where ticker is not null and tx_type in ('buy', 'sell') group by 1, 2),
r as (select *, row_number() over (partition by tx_type order by trades desc, people desc, ticker) as rank, count(*) over (partition by tx_type) as side_tickers from g) select * from r where rank <= 10""", "bounded")
def _(t: Tables) -> DataFrame:
    return d.side_ranking(recent(t))


@query("agg01_ranking_all_time", f"""with g as ({RANKING} from bounded where ticker is not null and tx_type in ('buy', 'sell') group by 1, 2)
select *, row_number() over (partition by tx_type order by trades desc, people desc, ticker) as rank, count(*) over (partition by tx_type) as side_tickers from g""", "bounded")
def _(t: Tables) -> DataFrame:
    return d.side_ranking(t.trades, top=None)


@query("agg03_nets_both_sides", f"with {WINDOW} select ticker, {NET} from w where ticker is not null and tx_type in ('buy', 'sell') group by ticker having count(*) filter (tx_type = 'buy') > 0 and count(*) filter (tx_type = 'sell') > 0", "bounded")
def _(t: Tables) -> DataFrame:
    return d.nets(recent(t), ["ticker"])


@query("agg12_person_ticker_rollup", f"with {WINDOW} select person_key, ticker, {NET} from w where ticker is not null and tx_type in ('buy', 'sell') group by 1, 2", "bounded")
def _(t: Tables) -> DataFrame:
    return d.nets(recent(t), ["person_key", "ticker"], both_sides=False)


@query("agg02_net_by_party", f"with x as (select *, case when high is not null then (low + high) / 2.0::double else low::double end as mid from bounded) select party, {NET} from x where ticker is not null and tx_type in ('buy', 'sell') group by 1", "bounded")
def _(t: Tables) -> DataFrame:
    return d.nets(t.trades, ["party"], both_sides=False)


@query("agg05_clusters", f"""with {WINDOW}, b as (select ticker, person_key, count(*) as n, sum(low) as low, max(tx_date) as last_tx, max({{'a': disclosed_date, 'b': filing_id, 'c': row_index, 'd': person_name, 'e': party}}) as latest
  from w where ticker is not null and tx_type = 'buy' group by 1, 2)
select ticker, count(*) as buyers, sum(n)::bigint as trades, coalesce(sum(low), 0)::bigint as sum_low, max(last_tx) as last_tx, list_sort(list(distinct latest.e)) as parties, max(latest).d as newest_buyer
from b group by 1 having count(*) >= 3 order by buyers desc, trades desc, ticker limit 20""", "bounded")
def _(t: Tables) -> DataFrame:
    return d.clusters(recent(t))


@query("joi02_ranked_with_nets", f"""with {WINDOW}, g as ({RANKING} from w where ticker is not null and tx_type in ('buy', 'sell') group by 1, 2), n as (select ticker, {NET} from w where ticker is not null and tx_type in ('buy', 'sell') group by 1)
select tx_type, ticker, trades, net_count, net_estimate from g join n using (ticker)""", "bounded")
def _(t: Tables) -> DataFrame:
    r = d.side_ranking(recent(t), top=None).select("tx_type", "ticker", "trades")
    return r.join(d.nets(recent(t), ["ticker"], both_sides=False).select("ticker", "net_count", "net_estimate"), "ticker")


@query("win02_nets_ranked", f"""with {WINDOW}, n as (select ticker, {NET} from w where ticker is not null and tx_type in ('buy', 'sell') group by 1)
select ticker, net_estimate, row_number() over (order by net_estimate desc nulls last, ticker) as rank, count(*) over () as total from n""", "bounded")
def _(t: Tables) -> DataFrame:
    n = d.nets(recent(t), ["ticker"], both_sides=False)
    placed = ranks.numbered(n.select("ticker", "net_estimate"), [F.col("net_estimate").desc_nulls_last(), F.col("ticker")])
    return placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("total"))))  # one row beside each


@query("joi07_filings_without_ticker", "select f.filing_id, f.person_key from filings f where not exists (select 1 from trades t where t.filing_id = f.filing_id and t.ticker is not null)", "filings trades")
def _(t: Tables) -> DataFrame:
    return t.filings.join(t.trades.where("ticker is not null"), "filing_id", "left_anti").select("filing_id", "person_key")


@query("agg13_excluded_filings", f"select count(*) as filings, max(filed_date) as newest from filings f where filed_date between date '{AS_OF}' - 29 and date '{AS_OF}' and not exists (select 1 from trades t where t.filing_id = f.filing_id and t.ticker is not null)", "filings trades")
def _(t: Tables) -> DataFrame:
    f = d.in_window(t.filings, AS_OF, DAYS, "filed_date")
    return f.join(t.trades.where("ticker is not null"), "filing_id", "left_anti").agg(F.count("*").alias("filings"), F.max("filed_date").alias("newest"))


@query("joi08_people_with_trades", "select distinct c_custkey from customer c where exists (select 1 from trades t where t.person_key = c.c_custkey)", "trades")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.trades, F.col("c_custkey") == F.col("person_key"), "left_semi")


@query("joi03_people_counts", "select c_custkey, c_name, coalesce(n, 0) as trades from customer left join (select person_key, count(*) as n from trades group by 1) on person_key = c_custkey", "trades")
def _(t: Tables) -> DataFrame:
    n = t.trades.groupBy("person_key").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("person_key"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("trades"))


@query("fil05_members", "select office, count(*) as n from trades where filer_status is distinct from 'candidate' group by 1", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where(d.by_filer("member")).groupBy("office").agg(F.count("*").alias("n"))


@query("fil06_president_office", "select office, tx_type, count(*) as n from trades where office in ('president', 'vice-president') group by 1, 2", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where(d.by_office("president")).groupBy("office", "tx_type").agg(F.count("*").alias("n"))


@query("fil02_feed_filter", "select filing_id, row_index from trades where office = 'senate' and party = 'D' and tx_type = 'buy' and disclosed_date >= date '1998-01-01' and disclosed_date <= date '1998-12-31' and filer_status is distinct from 'candidate' and lower(concat_ws(' ', person_name, ticker)) like '%brand%'", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where(d.feed_filter(office="senate", party="D", tx_type="buy", since="1998-01-01", until="1998-12-31", filer="member", search="brand", ticker="")).select("filing_id", "row_index")


@query("fil07_substring_search", "select c_custkey, c_name from customer where c_name ilike '%00\\_1%' escape '\\' or c_name ilike '%12%'")
def _(t: Tables) -> DataFrame:
    return t.customer.where(F.lower("c_name").contains("00_1") | F.lower("c_name").contains("12")).select("c_custkey", "c_name")


@query("set01_feed_union", "select 'trade' as kind, concat_ws(':', filing_id, row_index) as id, person_name, ticker, tx_type, disclosed_date from trades union all select 'review', filing_id::varchar, person_name, null, null, filed_date from filings where parse_status = 'needs_manual_review'", "trades filings")
def _(t: Tables) -> DataFrame:
    return d.feed(t.trades, t.filings)


@query("srt03_feed_page", "select 'trade' as kind, concat_ws(':', filing_id, row_index) as id, person_name, ticker, tx_type, disclosed_date from trades order by disclosed_date desc nulls last, id desc limit 40 offset 80", "trades")
def _(t: Tables) -> DataFrame:
    return d.page(d.feed(t.trades, t.filings).where("kind = 'trade'"), 80, 40)


@query("agg09_span_label", f"""with {WINDOW}, g as (select ticker, sum(low) as low, sum(high) as high, count(*) filter (low is not null and high is null) as o, count(*) filter (low is null) as x from w where ticker is not null group by 1)
select ticker, case when o > 0 or x > 0 then 'Over $' || format('{{:,}}', low::bigint) else '$' || format('{{:,}}', low::bigint) || ' - $' || format('{{:,}}', high::bigint) end as label from g where low is not null""", "bounded")
def _(t: Tables) -> DataFrame:
    x = d.with_bounds(recent(t).where("ticker is not null")).groupBy("ticker").agg(
        F.sum("low").alias("low"), F.sum("high").alias("high"), F.count_if(F.col("low").isNotNull() & F.col("high").isNull()).alias("o"), F.count_if(F.col("low").isNull()).alias("x")
    )
    return x.where("low is not null").select("ticker", d.span_label(F.col("low"), F.col("high"), F.col("o"), F.col("x")).alias("label"))


@query("agg10_counts_by_side", "select count(*) as n, count(*) filter (tx_type = 'buy') as buys, count(*) filter (tx_type = 'sell') as sells, max(disclosed_date) as newest from trades", "trades")
def _(t: Tables) -> DataFrame:
    side = lambda s: F.count_if(F.col("tx_type") == s)
    return t.trades.agg(F.count("*").alias("n"), side("buy").alias("buys"), side("sell").alias("sells"), F.max("disclosed_date").alias("newest"))


@query("agg11_held_tickers", "select ticker, count(*) as trades, max(tx_date) as newest from trades where ticker in ('Brand#11-ECONOMY', 'Brand#12-STANDARD') or ticker like 'Brand#2%' group by 1", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.where(F.col("ticker").isin("Brand#11-ECONOMY", "Brand#12-STANDARD") | F.col("ticker").startswith("Brand#2")).groupBy("ticker").agg(F.count("*").alias("trades"), F.max("tx_date").alias("newest"))


@query("agg32_top_tickers_per_person", "with g as (select person_key, ticker, count(*) as n from trades where ticker is not null group by 1, 2) select * from g qualify row_number() over (partition by person_key order by n desc, ticker) <= 8", "trades")
def _(t: Tables) -> DataFrame:
    g = t.trades.where("ticker is not null").groupBy("person_key", "ticker").agg(F.count("*").alias("n"))
    return g.withColumn("j", F.row_number().over(Window.partitionBy("person_key").orderBy(F.desc("n"), "ticker"))).where("j <= 8").drop("j")


@query("set02_distinct_people", "select person_key from trades union select person_key from filings union select c_custkey from customer where c_acctbal < 0", "trades filings")
def _(t: Tables) -> DataFrame:
    return t.trades.select("person_key").union(t.filings.select("person_key")).union(t.customer.where("c_acctbal < 0").select("c_custkey")).distinct()


@query("set03_identity_priority", "with u as (select person_key, party, 0 as pri, filed_date from filings where parse_status = 'parsed' union all select person_key, party, 1, filed_date from filings where parse_status <> 'parsed') select person_key, party, pri::int as pri, filed_date from u qualify row_number() over (partition by person_key order by pri, filed_date desc, party) = 1", "filings")
def _(t: Tables) -> DataFrame:
    f = t.filings
    u = f.where("parse_status = 'parsed'").select("person_key", "party", F.lit(0).alias("pri"), "filed_date").unionByName(f.where("parse_status <> 'parsed'").select("person_key", "party", F.lit(1).alias("pri"), "filed_date"))
    return u.withColumn("j", F.row_number().over(Window.partitionBy("person_key").orderBy("pri", F.desc("filed_date"), "party"))).where("j = 1").drop("j")


@query("set05_keys_not_stored", "select o_orderkey from orders except select l_orderkey from lineitem")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("set06_first_by_key", "select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


@query("str21_word_prefix_search", "select s_suppkey, s_name from supplier where len(list_filter(string_split_regex(lower(s_name), '[^a-z0-9]+'), lambda w: starts_with(w, 'supp'))) > 0 and len(list_filter(string_split_regex(lower(s_name), '[^a-z0-9]+'), lambda w: starts_with(w, '0000'))) > 0")
def _(t: Tables) -> DataFrame:
    words = F.split(F.lower("s_name"), "[^a-z0-9]+")
    return t.supplier.where(d.word_prefix_match(words, "supp 0000")).select("s_suppkey", "s_name")


@query("joi17_unique_match", """with r as (select c_nationkey as state, c_custkey % 7 as district, c_mktsegment as last, c_custkey % 5 as first, c_name from customer),
l as (select s_suppkey, s_nationkey as state, s_suppkey % 7 as district, 'BUILDING' as last, s_suppkey % 5 as first from supplier),
a as (select state, district, last, count(*) as n, any_value(c_name) as v from r group by all), b as (select state, district, last, first, count(*) as n, any_value(c_name) as v from r group by all)
select s_suppkey, case when a.n = 1 then a.v when a.n > 1 and b.n = 1 then b.v end as c_name from l left join a using (state, district, last) left join b using (state, district, last, first)""")
def _(t: Tables) -> DataFrame:
    """By state, district and last name; several of one name by their first names."""
    right = t.customer.select(F.col("c_nationkey").alias("state"), (F.col("c_custkey") % 7).alias("district"), F.col("c_mktsegment").alias("last"), (F.col("c_custkey") % 5).alias("first"), "c_name")
    left = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("state"), (F.col("s_suppkey") % 7).alias("district"), F.lit("BUILDING").alias("last"), (F.col("s_suppkey") % 5).alias("first"))
    return d.unique_match(left, right, ["state", "district", "last"], "c_name", "first").select("s_suppkey", "c_name")


@query("rec03_current_filing", """with k as (select *, row_number() over (partition by person_key order by filed_date desc, filing_id desc) as j, row_number() over (partition by person_key, year(filed_date), parse_status <> 'needs_manual_review' order by filed_date desc, filing_id desc) as jy from filings),
n as (select * from k where j = 1), f as (select person_key, year(filed_date) as y, filing_id from k where jy = 1 and parse_status <> 'needs_manual_review')
select n.person_key, case when n.parse_status <> 'needs_manual_review' then n.filing_id else coalesce(f.filing_id, n.filing_id) end as filing_id, n.parse_status = 'needs_manual_review' as newer_unreadable
from n left join f on f.person_key = n.person_key and f.y = year(n.filed_date)""", "filings")
def _(t: Tables) -> DataFrame:
    return d.current_filing(t.filings).drop("parse_status")


@query("rec05_person_page", "select person_key, max(person_name) as person_name, count(*) filter (tx_type = 'buy') as buys, count(*) filter (tx_type = 'sell') as sells, count(distinct ticker) as tickers, max(disclosed_date) as newest, avg(date_diff('day', tx_date, disclosed_date)) as mean_lag from trades group by 1", "trades")
def _(t: Tables) -> DataFrame:
    return t.trades.groupBy("person_key").agg(
        F.max("person_name").alias("person_name"), F.count_if(F.col("tx_type") == "buy").alias("buys"), F.count_if(F.col("tx_type") == "sell").alias("sells"),
        F.countDistinct("ticker").alias("tickers"), F.max("disclosed_date").alias("newest"), F.avg(F.datediff("disclosed_date", "tx_date")).alias("mean_lag"),
    )
