"""Queries on names and symbols as they are written, ingest plans and patches. What a written form means is stated in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import books, disclosures
from ..sources.tables import Tables
from .records import cases_sql, choose, choose_sql
from .registry import query
from .series import month_levels


def forms(name: str, column: str, pairs: list[tuple[str | None, str | None]], apply) -> None:
    """A query that applies a function to written forms, one for each part, and the SQL that states their meanings."""
    sql = f"with r as (select p_partkey, {choose_sql('p_partkey', [a for a, _ in pairs])} as raw from part) select p_partkey, {cases_sql('raw', [(a, b) for a, b in pairs if a is not None])} as {column} from r"
    query(name, sql)(lambda t: t.part.select("p_partkey", apply(choose(F.col("p_partkey"), [a for a, _ in pairs])).alias(column)))


forms("str08_split_suffix", "name", [("NETFLIXINC", "NETFLIX INC"), ("Costco", "Costco"), ("BANCORP", "BANCORP"), ("Pfizerco", "Pfizer co"), ("abco", "abco"), ("Acme Corp", "Acme Corp"), ("Deltagroup x", "Delta group x"), ("EATONCORP plc", "EATON CORP plc"), ("Zinc", "Zinc")], labels.split_suffix)
forms("str15_short_name", "name", [("Balanced Growth", "Bal Gr"), ("Conservative", "Cons"), ("Income", "Inco"), ("Global Small Caps", "Glo Sma Cap"), ("  ", "")], labels.short_name)
forms("str16_short_holding", "name", [("Acme Fund Location: US", "Acme Fund"), ("Real  estate,", "Real estate"), ("Trust See line 4", "Trust"), ("Location", "Location"), ("  ", "Holding"), ("x" * 80, "x" * 69 + "...")], labels.short_holding)
forms("str18_feed_symbol", "symbol", [("RY.TO", "ry.ca"), ("vod.L", "vod.uk"), ("AAPL", "aapl.us"), ("BRK.B", "brk.b"), ("  ", None)], labels.feed_symbol)
forms("str19_detected_ticker", "ticker", [("Apple Inc. (AAPL)", "AAPL"), ("in (USD) of (brk.b)", "BRK.B"), ("(CAD)", None), ("none", None), ("(toolongname) (X)", "X")], labels.detected_ticker)
forms("str19_detected_currency", "currency", [("Currency in USD", "USD"), ("TSX • CAD", "CAD"), ("Currency in XYZ • EUR", "EUR"), ("USD", None)], labels.detected_currency)


@query("str15_weight_percent", "select distinct l_discount, case when round(l_discount * 100) = round(l_discount * 100, 1) then round(l_discount * 100)::int::varchar || '%' end as percent from lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_discount").distinct().select("l_discount", labels.weight_percent(F.col("l_discount")).alias("percent"))


@query("str12_mapped_labels", """with r as (select n_nationkey as id, case n_nationkey % 6 when 0 then 'Info Tech*' when 1 then 'Total assets' when 2 then ' Utilities ' when 3 then 'cash equivalents' when 4 then 'Healthcare' else null end as raw from nation)
select id, case n when 'info tech' then 'Technology' when 'healthcare' then 'Health Care' else trim(raw) end as label from (select *, trim(lower(replace(raw, '*', ''))) as n from r) where n is not null and n not like 'total%' and n not like 'cash%'""")
def _(t: Tables) -> DataFrame:
    """Aliases are a table; labels without one stay as written."""
    alias = t.nation.limit(1).select(F.explode(F.create_map(F.lit("info tech"), F.lit("Technology"), F.lit("healthcare"), F.lit("Health Care"))).alias("k", "alias"))
    raw = choose(F.col("n_nationkey"), ["Info Tech*", "Total assets", " Utilities ", "cash equivalents", "Healthcare", None])
    x = t.nation.select(F.col("n_nationkey").alias("id"), raw.alias("raw")).where(~labels.is_no_label(F.col("raw"))).withColumn("k", labels.label_key(F.col("raw")))
    return x.join(alias, "k", "left").select("id", F.coalesce("alias", F.trim("raw")).alias("label"))


@query("arr02_pick_percents", "select n_nationkey as id, case n_nationkey % 4 when 0 then [60.0::double, 40.0] when 1 then [70.0::double, 30.0] when 2 then [50.0::double, 50.0] else [40.0::double] end as percents from nation")
def _(t: Tables) -> DataFrame:
    """Two are wanted of 60, 40, 5; of 9, 70, 30; of 10, 20, 50, 50; and of 40 alone."""
    k = F.col("n_nationkey") % 4
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    raw = F.when(k == 0, arr(60, 40, 5)).when(k == 1, arr(9, 70, 30)).when(k == 2, arr(10, 20, 50, 50)).otherwise(arr(40))
    return t.nation.select(F.col("n_nationkey").alias("id"), labels.pick_percents(raw, F.lit(2)).alias("percents"))


@query("stm04_append_quote", """with q as (select symbol, case ascii(symbol) % 3 when 0 then max(date) when 1 then max(date) + 1 else max(date) - 1 end as date, 7.5::double as price from daily_points group by 1),
ok as (select symbol, date, price as close from q where ascii(symbol) % 3 < 2) select symbol, date, close from daily_points where (symbol, date) not in (select (symbol, date) from ok) union all select * from ok""", "daily_points")
def _(t: Tables) -> DataFrame:
    m = F.ascii("symbol") % 3
    last = t.daily_points.groupBy("symbol").agg(F.max("date").alias("d"))
    quotes = last.select("symbol", F.when(m == 0, F.col("d")).when(m == 1, F.date_add("d", 1)).otherwise(F.date_sub("d", 1)).alias("date"), F.lit(7.5).alias("price"))
    return books.append_quote(t.daily_points, quotes)


@query("stm05_ingest_plan", """with i as (select o_orderkey as key, cast(o_orderdate as date) as filed, o_orderkey % 3 = 0 as stored, o_orderkey % 5 as strikes from orders), w as (select key from i where not stored and strikes < 3 order by filed desc, key limit 25)
select key, case when stored then 'stored' when strikes >= 3 then 'resting' when key in (select key from w) then 'fetch' else 'later' end as plan from i""")
def _(t: Tables) -> DataFrame:
    i = t.orders.select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("filed"))
    return books.ingest_plan(i, i.where("key % 3 = 0"), i.select("key", (F.col("key") % 5).alias("strikes")), 25)


@query("stm11_revisit", "select o_orderkey as key, case when o_orderkey % 4 > 0 then o_orderkey % 4 end as parser_version, cast(o_orderdate as date) as filed from orders where coalesce(case when o_orderkey % 4 > 0 then o_orderkey % 4 end, 0) < 3 order by coalesce(parser_version, 0), filed desc, key limit 40")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return books.revisit(t.orders.select(k.alias("key"), F.when(k % 4 > 0, k % 4).alias("parser_version"), F.to_date("o_orderdate").alias("filed")), 3, 40)


@query("rec07_locked_patch", """select n_nationkey as id, case when n_nationkey % 2 = 0 and n_nationkey % 3 <> 0 then 'new' else n_name end as name, case when n_nationkey % 2 = 0 then 'US' else 'CA' end as country from nation""")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    now = t.nation.select(k.alias("id"), F.col("n_name").alias("name"), F.lit("CA").alias("country"), F.when(k % 3 == 0, F.array(F.lit("name"))).alias("locked"))
    quotes = t.nation.where(k % 2 == 0).select(k.alias("id"), F.lit("new").alias("name"), F.lit("US").alias("country"))
    return books.patched(now, quotes, "id", ["name", "country"]).drop("locked")


@query("fin19_range_return", "select symbol, round(arg_max(close, date) / arg_min(close, date) - 1, 8) as ret, min(date) as first, max(date) as last from daily_points where date >= date '2024-01-05' and date <= date '2024-01-20' group by 1", "daily_points")
def _(t: Tables) -> DataFrame:
    x = t.daily_points.where("date >= '2024-01-05' and date <= '2024-01-20'").groupBy("symbol")
    return x.agg(F.round(F.max_by("close", "date") / F.min_by("close", "date") - 1, 8).alias("ret"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("fin23_price_path", """with me as (select symbol, cast(date_trunc('month', date) as date) as month from price_points group by 1, 2), a as (select symbol, count(*) as n from me where ascii(symbol) % 2 = 0 or month < date '1995-01-01' group by 1), b as (select symbol, count(*) as n from me where month >= date '1996-01-01' group by 1)
select symbol, case when coalesce(a.n, 0) >= coalesce(b.n, 0) then 'first' else 'second' end as path, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as points from a full join b using (symbol)""", "price_points")
def _(t: Tables) -> DataFrame:
    me = month_levels(t)
    return books.longer_support(me.where((F.ascii("symbol") % 2 == 0) | (F.col("month") < "1995-01-01")), me.where("month >= '1996-01-01'"))


@query("rec12_lookup_precedence", """select n_nationkey as id, case when n_nationkey % 4 = 0 then 'quote' when n_nationkey % 3 = 0 then 'profile' when n_regionkey = 1 then 'offline' else 'suffix' end as source from nation""")
def _(t: Tables) -> DataFrame:
    """Of ranked providers the first that knows a symbol, else what its suffix says."""
    k = F.col("n_nationkey")
    found = [t.nation.where(c).select(k.alias("id"), F.lit(s).alias("source"), F.lit(r).alias("rank")) for r, (s, c) in enumerate((("quote", k % 4 == 0), ("profile", k % 3 == 0), ("offline", F.col("n_regionkey") == 1)))]
    best = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("id").agg(F.min_by("source", "rank").alias("source"))
    return t.nation.select(k.alias("id")).join(best, "id", "left").select("id", F.coalesce("source", F.lit("suffix")).alias("source"))


@query("rec11_normal_series", "select o_custkey as key, cast(o_orderdate as date) as date, max(o_totalprice) as value from orders where o_orderkey % 7 <> 0 and o_totalprice > 50000 group by 1, 2")
def _(t: Tables) -> DataFrame:
    """Points of a store as text: unread dates and values go, and of one day the last in order stays (here the largest)."""
    k = F.col("o_orderkey") % 7
    raw = t.orders.select(F.col("o_custkey").alias("key"), F.when(k == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice").cast("string")).otherwise("-").alias("v"))
    x = raw.select("key", F.try_to_date("d", "yyyy-MM-dd").alias("date"), F.col("v").try_cast("double").alias("value")).where("date is not null and value is not null")
    return x.groupBy("key", "date").agg(F.max("value").alias("value"))


@query("rec19_year_windows", "select distinct year(o_orderdate)::bigint as year, make_date(year(o_orderdate)::int, 1, 1) as start, make_date(year(o_orderdate)::int, 12, 31) as until from orders")
def _(t: Tables) -> DataFrame:
    y = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    return y.select(F.col("year").cast("long").alias("year"), F.make_date("year", F.lit(1), F.lit(1)).alias("start"), F.make_date("year", F.lit(12), F.lit(31)).alias("until"))


@query("jsn03_normal_settings", """with s as (select n_nationkey as id, case n_nationkey % 4 when 0 then 15.0 when 1 then 250.0 when 2 then -3.0 else null end as threshold, n_nationkey % 3 as flag from nation)
select id, case when threshold is null then 10.0::double else least(90, greatest(1, threshold))::double end as threshold, flag = 1 as enabled, left('note of ' || id::varchar || repeat('x', 40), 20) as note from s""")
def _(t: Tables) -> DataFrame:
    """Settings as stored JSON: numbers clamped or defaulted, flags read strictly, text cut, unknown keys dropped."""
    k = F.col("n_nationkey")
    threshold = F.when(k % 4 == 0, '"15"').when(k % 4 == 1, "250").when(k % 4 == 2, "-3").otherwise('"x"')
    doc = F.concat(F.lit('{"thresholdPct":'), threshold, F.lit(',"enabled":'), F.when(k % 3 == 1, "true").otherwise('"yes"'), F.lit(',"note":"note of '), k.cast("string"), F.lit("x" * 40 + '","other":1}'))
    s = t.nation.select(k.alias("id"), doc.alias("doc"))
    number = F.get_json_object("doc", "$.thresholdPct").try_cast("double")
    return s.select(
        "id", F.when(number.isNotNull(), F.least(F.lit(90.0), F.greatest(F.lit(1.0), number))).otherwise(10.0).alias("threshold"), (F.get_json_object("doc", "$.enabled") == "true").alias("enabled"), F.left(F.get_json_object("doc", "$.note"), F.lit(20)).alias("note")
    )


@query("rec06_defaults", "select p_partkey, coalesce(nullif(left(trim(p_name), 12), ''), 'Unnamed') as name, case when p_size % 3 = 0 then 'stock' else 'etf' end as type, case when p_size % 4 = 0 then date '2024-01-31' end as as_of from part")
def _(t: Tables) -> DataFrame:
    """A written instrument with defaults: names are cut, an unknown type is a stock, a date that is none is left out."""
    kind = F.when(F.col("p_size") % 3 == 0, "gadget").otherwise("etf")
    date = F.when(F.col("p_size") % 4 == 0, "2024-01-31").otherwise("2024-13-99")
    return t.part.select(
        "p_partkey", F.coalesce(F.nullif(F.left(F.trim("p_name"), F.lit(12)), F.lit("")), F.lit("Unnamed")).alias("name"),
        F.when(kind.isin("stock", "etf", "mutualfund", "cash", "alt"), kind).otherwise("stock").alias("type"), F.try_to_date(date, "yyyy-MM-dd").alias("as_of"),
    )


@query("rec15_net_lines", """with n as (select ticker, count(*) filter (tx_type = 'buy') as b, count(*) filter (tx_type = 'sell') as s from trades where ticker is not null and tx_type in ('buy', 'sell') group by 1 having count(*) filter (tx_type = 'buy') > 0 and count(*) filter (tx_type = 'sell') > 0)
select ticker, ticker || ': ' || b || ' bought, ' || s || ' sold, net ' || case when b > s then '+' else '' end || (b - s) as line from n""", "trades")
def _(t: Tables) -> DataFrame:
    n = disclosures.nets(t.trades, ["ticker"])
    text = F.concat("ticker", F.lit(": "), F.col("buys").cast("string"), F.lit(" bought, "), F.col("sells").cast("string"), F.lit(" sold, net "), F.when(F.col("net_count") > 0, "+").otherwise(""), F.col("net_count").cast("string"))
    return n.select("ticker", text.alias("line"))


@query("rec16_evaluation", """with p as (select symbol, count(*) as n from daily_points where date >= date '2024-01-08' group by 1), v as (select symbol, count(*) as n from daily_points where date < date '2024-01-08' and ascii(symbol) % 2 = 0 group by 1)
select s.symbol, case when v.n is not null then 'value' when p.n is not null then 'price' else 'none' end as basis, case when s.symbol like 'c%' then 'not priced' when v.n is null and p.n is null then 'no history' end as skipped from (select distinct symbol from daily_points) s left join p using (symbol) left join v using (symbol)""", "daily_points")
def _(t: Tables) -> DataFrame:
    """A holding's own values go before its prices; what is skipped says why."""
    d = t.daily_points
    price = d.where("date >= '2024-01-08'").select("symbol", F.lit("price").alias("basis"), F.lit(1).alias("rank")).distinct()
    value = d.where((F.col("date") < "2024-01-08") & (F.ascii("symbol") % 2 == 0)).select("symbol", F.lit("value").alias("basis"), F.lit(0).alias("rank")).distinct()
    best = price.unionByName(value).groupBy("symbol").agg(F.min_by("basis", "rank").alias("basis"))
    x = d.select("symbol").distinct().join(best, "symbol", "left").withColumn("basis", F.coalesce("basis", F.lit("none")))
    return x.withColumn("skipped", F.when(F.col("symbol").startswith("c"), "not priced").when(F.col("basis") == "none", "no history"))


@query("rec23_nested_summary", "select office, list_sort(list({'status': parse_status, 'n': n})) as statuses, sum(n)::bigint as total from (select office, parse_status, count(*) as n from filings group by 1, 2) group by 1", "filings")
def _(t: Tables) -> DataFrame:
    g = t.filings.groupBy("office", "parse_status").agg(F.count("*").alias("n"))
    return g.groupBy("office").agg(F.array_sort(F.collect_list(F.struct(F.col("parse_status").alias("status"), "n"))).alias("statuses"), F.sum("n").alias("total"))


@query("rec26_run_health", "select c_custkey, case when last is null then 'never' when date '1998-08-01' - last > 30 then 'stale' else 'fresh' end as health from customer left join (select o_custkey, max(cast(o_orderdate as date)) as last from orders group by 1) on o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    last = t.orders.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    x = t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    age = F.datediff(F.lit("1998-08-01").cast("date"), "last")
    return x.select("c_custkey", F.when(F.col("last").isNull(), "never").when(age > 30, "stale").otherwise("fresh").alias("health"))


@query("rec27_source_labels", "select p_partkey, case when p_size % 4 = 0 then 'Series' when p_size % 4 = 1 then 'Live quote' when p_size % 4 = 2 then 'Typed in' else 'No price' end as label, case p_partkey % 3 when 0 then 'daily' when 1 then 'monthly' else '—' end as cadence from part")
def _(t: Tables) -> DataFrame:
    source = choose(F.col("p_size"), ["series", "auto", "manual", None])
    label = labels.named(source, {"series": "Series", "auto": "Live quote", "manual": "Typed in"}, F.lit("No price"))
    cadence = labels.named(choose(F.col("p_partkey"), ["stock", "mutualfund", "cash"]), {"stock": "daily", "etf": "daily", "mutualfund": "monthly", "alt": "monthly"}, F.lit("—"))
    return t.part.select("p_partkey", label.alias("label"), cadence.alias("cadence"))


@query("rec29_save_accounting", "select o_custkey, count(*) as sent, count(*) filter (o_orderkey % 3 <> 0) as inserted, count(*) filter (o_orderkey % 3 = 0) as present, count(*) filter (o_orderkey % 3 = 0) = count(*) as nothing_new from orders group by 1")
def _(t: Tables) -> DataFrame:
    """What a bundle of children adds beside those that are stored."""
    sent = t.orders.select("o_custkey", "o_orderkey")
    x = sent.join(sent.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(True).alias("there")), "o_orderkey", "left")
    return x.groupBy("o_custkey").agg(F.count("*").alias("sent"), F.count_if(F.col("there").isNull()).alias("inserted"), F.count_if("there").alias("present"), (F.count_if("there") == F.count("*")).alias("nothing_new"))


@query("rec30_work_queue", "select key, min(rank) = 0 as pending from (select o_orderkey as key, 0 as rank from orders where o_orderkey % 11 = 0 union all select o_orderkey, 1 from orders where o_orderkey % 5 = 0) where key % 2 = 1 group by 1")
def _(t: Tables) -> DataFrame:
    """Pending keys and fresh ones of the index, without those that are settled."""
    k = t.orders.select(F.col("o_orderkey").alias("key"))
    both = k.where("key % 11 = 0").withColumn("rank", F.lit(0)).unionByName(k.where("key % 5 = 0").withColumn("rank", F.lit(1)))
    return both.join(k.where("key % 2 = 0"), "key", "left_anti").groupBy("key").agg((F.min("rank") == 0).alias("pending"))


@query("rec31_replace_parse", """with old as (select l_orderkey as parent, l_linenumber as child, 1 as version from lineitem), again as (select distinct l_orderkey as parent from lineitem where l_orderkey % 6 = 0 and l_linenumber <= 2)
select parent, child, version from old where parent not in (select parent from again) union all select parent, child, 2 from old where parent in (select parent from again) and child <= 2""")
def _(t: Tables) -> DataFrame:
    """Rows of an older parser are read again; what comes out replaces all that it gave."""
    old = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.lit(1).alias("version"))
    new = old.where("parent % 6 = 0 and child <= 2").withColumn("version", F.lit(2))
    return books.replace_children(old, new, "parent")
