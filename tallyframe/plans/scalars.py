"""Queries that apply the scalar functions, dates, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..sources.tables import Tables
from .registry import query


@query("str01_canonical_ticker", r"""with r as (select p_partkey, case p_partkey % 7 when 0 then ' brk/' || chr(97 + cast(p_size % 26 as int)) when 1 then 'N/A' when 2 then lower(p_brand) when 3 then 'ry.to ' when 4 then '--' when 5 then 'etf' else p_type end as raw from part),
s as (select p_partkey, regexp_replace(upper(trim(raw)), '\s+', '', 'g') as b from r), c as (select *, case when regexp_full_match(b, '[A-Z]{1,5}[/-][A-Z]') then left(b, len(b) - 2) || '.' || right(b, 1) else b end as s from s)
select p_partkey, case when b not in ('--', '-', 'N/A', 'NA', 'NONE', 'NULL', 'UNKNOWN') and s not in ('INC', 'LLC', 'LTD', 'CO', 'CORP', 'ETF', 'ADR', 'NEW', 'THE', 'AND', 'FOR', 'USD', 'CAD', 'NYSE', 'NASDAQ') and regexp_full_match(s, '[A-Z][A-Z0-9.]{0,11}') then s end as ticker from c""")
def _(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 7
    raw = F.when(m == 0, F.concat(F.lit(" brk/"), F.char(F.lit(97) + F.col("p_size") % 26))).when(m == 1, "N/A").when(m == 2, F.lower("p_brand")).when(m == 3, "ry.to ").when(m == 4, "--").when(m == 5, "etf").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", x.canonical_ticker(raw).alias("ticker"))


@query("str05_fold_words", r"select doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '\b(jr|sr|ii|iii|iv|hon|mr|mrs|ms|dr)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as folded from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.fold(F.col("text")).alias("folded"))


@query("str06_person_key", r"""with p as (select c_custkey, c_mktsegment as office, c_name as last, case when c_nationkey % 3 = 0 then '' else left(c_mktsegment, 3) || ' ' || c_mktsegment end as first from customer)
select c_custkey, concat_ws(':', office, trim(regexp_replace(lower(last), '[^a-z0-9]+', ' ', 'g')), nullif(split_part(trim(regexp_replace(lower(first), '[^a-z0-9]+', ' ', 'g')), ' ', 1), '')) as key from p""")
def _(t: Tables) -> DataFrame:
    first = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.concat_ws(" ", F.left("c_mktsegment", F.lit(3)), "c_mktsegment"))
    return t.customer.select("c_custkey", x.person_key(F.col("c_mktsegment"), F.col("c_name"), first).alias("key"))


@query("str07_asset_stem", r"""select p_partkey, trim(regexp_replace(trim(regexp_replace(lower(replace(p_name || case when p_size % 2 = 0 then ' & Co., Inc.' else ' Ltd' end, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')),
  '( (inc|incorporated|corp|corporation|co|company|ltd|limited|plc|llc|lp|sa|nv|ag|the))+$', '')) as stem from part""")
def _(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " & Co., Inc.").otherwise(" Ltd"))
    return t.part.select("p_partkey", x.asset_stem(name).alias("stem"))


@query("str09_similarity", "select a.n_name as a, b.n_name as b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name))::double, 8) as sim from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey")
def _(t: Tables) -> DataFrame:
    a, b = t.nation.select(F.col("n_name").alias("a"), "n_regionkey", F.col("n_nationkey").alias("i")), t.nation.select(F.col("n_name").alias("b"), "n_regionkey", F.col("n_nationkey").alias("j"))
    return a.join(b, "n_regionkey").where("i < j").select("a", "b", F.round(x.similarity(F.col("a"), F.col("b")), 8).alias("sim"))


_CLASS = " ".join(f"when regexp_matches(s, '{p}') then '{k}'" for k, p in x.CLASS_RULES)


@query("str23_asset_class", f"with d as (select p_partkey, lower(case p_size % 9 when 0 then p_name || ' call option' when 1 then 'US Treasury note' when 2 then 'iShares ETF' when 3 then 'Vanguard fund' when 4 then 'Bitcoin' when 5 then 'common stock' when 6 then 'real estate lot' when 7 then 'money market' else p_type end) as s from part) select p_partkey, case {_CLASS} else 'other' end as class from d")
def _(t: Tables) -> DataFrame:
    m = F.col("p_size") % 9
    names = ("US Treasury note", "iShares ETF", "Vanguard fund", "Bitcoin", "common stock", "real estate lot", "money market")
    d = F.when(m == 0, F.concat("p_name", F.lit(" call option")))
    for i, n in enumerate(names, 1):
        d = d.when(m == i, n)
    return t.part.select("p_partkey", x.asset_class(d.otherwise(F.col("p_type"))).alias("class"))


@query("str13_compact_dollars", """with x as (select o_orderkey, (case o_orderkey % 3 when 0 then o_totalprice when 1 then o_totalprice * 1000 else o_totalprice / 1000 end)::varchar::decimal(38,12) as v from orders)
select o_orderkey, case when v >= 1e6 then '$' || round(v / 1e6::decimal(10,0), 1)::decimal(20,1)::varchar || 'M' when v >= 1e3 then '$' || round(v / 1e3::decimal(10,0), 1)::decimal(20,1)::varchar || 'K' else '$' || round(v, 0)::bigint::varchar end as s from x""")
def _(t: Tables) -> DataFrame:
    m, p = F.col("o_orderkey") % 3, F.col("o_totalprice")
    return t.orders.select("o_orderkey", x.compact_dollars(F.when(m == 0, p).when(m == 1, p * 1000).otherwise(p / 1000)).alias("s"))


@query("str22_escape_html", "select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as s from pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.escape_html(F.col("html")).alias("s"))


@query("str17_listing", "select p_partkey, case p_size % 3 when 0 then 'CAD' when 1 then 'GBP' else 'USD' end as currency from part")
def _(t: Tables) -> DataFrame:
    m = F.col("p_size") % 3
    return t.part.select("p_partkey", x.listing_currency(F.concat(F.lit("ABC"), F.when(m == 0, ".TO").when(m == 1, ".L").otherwise(""))).alias("currency"))


@query("dat10_loose_date", "select o_orderkey, cast(o_orderdate as date) as d from orders where o_orderkey % 5 <> 4 union all select o_orderkey, null from orders where o_orderkey % 5 = 4")
def _(t: Tables) -> DataFrame:
    d, m = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    s = F.when(m == 0, F.date_format(d, "yyyy-MM-dd")).when(m == 1, F.date_format(d, "M/d/yyyy")).when(m == 2, F.date_format(d, "MMM d, yyyy")).when(m == 3, F.date_format(d, "yyyyMMdd")).otherwise("31/31/1999")
    return t.orders.select("o_orderkey", x.loose_date(s).alias("d"))


@query("dat04_calendar_years", "select o_orderkey, cast(cast(o_orderdate as date) - interval 12 month as date) as back, cast(date_trunc('quarter', o_orderdate) as date) - 1 as quarter_end, last_day(o_orderdate) as month_end from orders")
def _(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.add_months(d, -12).alias("back"), F.date_sub(F.trunc(d, "quarter"), 1).alias("quarter_end"), F.last_day(d).alias("month_end"))


@query("dat11_staleness", "select symbol, date, date_diff('day', date, date '2024-01-31') > 5 as stale, dayofweek(date) = 0 as sunday from daily_points", "daily_points")
def _(t: Tables) -> DataFrame:
    return t.daily_points.select("symbol", "date", (F.datediff(F.lit("2024-01-31").cast("date"), "date") > 5).alias("stale"), (F.dayofweek("date") == 1).alias("sunday"))


@query("jsn01_event_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("mth01_moments", "select l_returnflag, round(avg(l_discount), 8) as mean, round(stddev_samp(l_discount), 8) as sd, round(covar_samp(l_discount, l_tax), 8) as cov from lineitem group by 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 8).alias("mean"), F.round(F.stddev_samp("l_discount"), 8).alias("sd"), F.round(F.covar_samp("l_discount", "l_tax"), 8).alias("cov"))


@query("arr01_zip_unnest", "with a as (select o_custkey, list(o_orderkey order by o_orderkey) as ks, list(o_orderstatus order by o_orderkey) as ss from orders group by 1) select o_custkey, unnest(ks) as k, unnest(ss) as s, unnest(range(len(ks))) as i from a")
def _(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("a"))
    z = a.select("o_custkey", F.posexplode(F.arrays_zip(F.transform("a", lambda e: e["k"]).alias("k"), F.transform("a", lambda e: e["s"]).alias("s"))).alias("i", "z"))
    return z.select("o_custkey", F.col("z.k").alias("k"), F.col("z.s").alias("s"), F.col("i").cast("long").alias("i"))


@query("emb01_vector_norms", "select vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda e: e::double * e::double))), 4) as norm from embeddings")
def _(t: Tables) -> DataFrame:
    e = F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return t.embeddings.select("vec_id", "label", F.round(F.sqrt(e), 4).alias("norm"))
