"""Queries on written amounts, labels, eligibility, queues, coverage and published figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, money
from ..operators import books
from ..sources.tables import AMOUNT_RANGES, Tables
from .registry import query

def choose(n: Column, values: list[str | None]) -> Column:
    """One of some written forms, by a number."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


def choose_sql(n: str, values: list[str | None]) -> str:
    return f"list_extract([{', '.join('null' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}], cast({n} % {len(values)} + 1 as int))"


def cases_sql(value: str, pairs: list[tuple[str, str | None]], other: str = "null") -> str:
    """A case by written form: what each form of the fixture means, stated and not computed."""
    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    return f"case {value} " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in pairs) + f" else {other} end"


AMOUNTS: list[tuple[str | None, str | None]] = [
    ("$1,001 - $15,000", "$1,001 - $15,000"), ("  $15,001  –  $50,000 ", "$15,001 - $50,000"), ("50,001 — 100,000", "$50,001 - $100,000"), ("$1,001 - $50,000", None), ("Over $50,000,000", "Over $50,000,000"),
    ("over $1,000,000", None), ("$100,001 • $250,000", "$100,001 - $250,000"), ("about $8,000", None), ("", None), (None, None),
]
VALUES: list[tuple[str | None, str, str | None]] = [
    ("$1,001 - $15,000", "range", "$1,001 - $15,000"), ("None (or less than $1,001)", "excluded", "none"), ("Undetermined", "undetermined", "Undetermined"), ("Over $50,000,000", "at_least", "Over $50,000,000"),
    ("$1 - $1,000", "range", "$1 - $1,000"), ("--", "excluded", "not_disclosed"), ("N/A", "excluded", "not_disclosed"), ("$2 - $3", "unreadable", None), ("Over $1,000,000", "unreadable", None), (None, "unreadable", None),
    ("$500,001 - $1,000,000", "range", "$500,001 - $1,000,000"),
]


@query("str02_amount_range", f"with r as (select o_orderkey, {choose_sql('o_orderkey', [a for a, _ in AMOUNTS])} as raw from orders) select o_orderkey, {cases_sql('raw', [(a, b) for a, b in AMOUNTS if a is not None])} as label from r")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", money.amount_range(choose(F.col("o_orderkey"), [a for a, _ in AMOUNTS])).alias("label"))


_BOUNDS = " ".join(f"when '{label}' then {{}}".format(low) for label, low, _ in AMOUNT_RANGES), " ".join(f"when '{label}' then {high}" for label, _, high in AMOUNT_RANGES if high)


@query("str03_asset_value", f"""with r as (select o_orderkey, {choose_sql('o_orderkey', [v[0] for v in VALUES])} as raw from orders),
k as (select o_orderkey, {cases_sql('raw', [(a, b) for a, b, _ in VALUES if a is not None], "'unreadable'")} as kind, {cases_sql('raw', [(a, c) for a, _, c in VALUES if a is not None])} as label from r),
b as (select *, (case label {_BOUNDS[0]} when '$1 - $1,000' then 1 end)::bigint as low, (case label {_BOUNDS[1]} when '$1 - $1,000' then 1000 end)::bigint as high from k)
select o_orderkey, kind, case when kind = 'at_least' then 50000000 when kind = 'range' then low end as low, case when kind = 'range' then high end as high,
  case when kind = 'at_least' then 50000000 when kind = 'range' then floor((low + high) / 2 + 0.5)::bigint end as mid, label from b""")
def _(t: Tables) -> DataFrame:
    v = money.asset_value(choose(F.col("o_orderkey"), [v[0] for v in VALUES]))
    return t.orders.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


OWNERS: list[tuple[str | None, str]] = [("SP", "spouse"), ("jt", "joint"), ("Dependent Child", "child"), ("--", "self"), ("held by spouse", "spouse"), ("child (DC)", "child"), ("someone", "unknown"), ("Self", "self"), ("spouses", "unknown"), (None, "unknown")]


@query("str04_labels", f"""select filing_id, {cases_sql(choose_sql('filing_id', [o for o, _ in OWNERS]), [(o, w) for o, w in OWNERS if o], "'unknown'")} as owner,
case office when 'house' then 'House' when 'senate' then 'Senate' when 'president' then 'President' else 'Vice President' end as office, case party when 'D' then 'Democrat' when 'R' then 'Republican' else 'Independent' end as party,
case when filing_id % 3 = 0 then 'Buy (partial)' when filing_id % 3 = 1 then 'Sell' else 'Other' end as side from filings""", "filings")
def _(t: Tables) -> DataFrame:
    n = F.col("filing_id") % 3
    side = labels.side_label(F.when(n == 0, "buy").when(n == 1, "sell").otherwise("gift"), n == 0)
    who = labels.owner(choose(F.col("filing_id"), [o for o, _ in OWNERS]))
    return t.filings.select("filing_id", who.alias("owner"), labels.office_label(F.col("office")).alias("office"), labels.party_label(F.col("party")).alias("party"), side.alias("side"))


TOKENS = [("Purchase", "purchase"), ("ourchase", "purchase"), ("Sal e", "sale"), ("sole", "sale"), ("exchange.", "exchange"), ("exchang", "exchange"), ("sl", None), ("gift", None), ("purchses", None)]


@query("str10_type_word", f"with r as (select p_partkey, {choose_sql('p_partkey', [a for a, _ in TOKENS])} as raw from part) select p_partkey, {cases_sql('raw', TOKENS)} as word from r")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", labels.type_word(choose(F.col("p_partkey"), [a for a, _ in TOKENS])).alias("word"))


SCANS = [("$l,OOI - $15,OOO", "$1,001 - $15,000", "f"), ("$15,000 - $50,000", "$15,001 - $50,000", "t"), ("$1 - $1,000", None, None), ("$ 1,001 $ 15,000", "$1,001 - $15,000", "f"), ("$15,000 to $50,000", None, None), ("$5O,OO1 – $1OO,OOO", "$50,001 - $100,000", "f"), ("$7,000 - $9,000", None, None)]


@query("str11_scanned_range", f"with r as (select p_partkey, {choose_sql('p_partkey', [s[0] for s in SCANS])} as raw from part) select p_partkey, {cases_sql('raw', [s[:2] for s in SCANS])} as label, {cases_sql('raw', [(s[0], s[2]) for s in SCANS])} = 't' as repaired from r")
def _(t: Tables) -> DataFrame:
    r = money.scanned_range(choose(F.col("p_partkey"), [s[0] for s in SCANS]))
    return t.part.select("p_partkey", r["label"].alias("label"), r["repaired"].alias("repaired"))


@query("str14_percents", """select l_returnflag, l_linestatus, d::varchar || '.0%' as discount, '+' || d::varchar || '.0%' as change, '—' as missing from (
  select distinct l_returnflag, l_linestatus, cast(round(l_discount * 100) as int) as d from lineitem) where d > 0""")
def _(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    x = t.lineitem.select("l_returnflag", "l_linestatus", "l_discount").distinct().where(d > 0)
    return x.select("l_returnflag", "l_linestatus", money.percent(d).alias("discount"), money.percent(d, signed=True).alias("change"), money.percent(F.lit(None).cast("double")).alias("missing"))


SYMBOLS = [("RY.TO", "CAD", "TSX", "Canada"), ("abc.v", "CAD", "TSXV", "Canada"), ("RBF1005", "CAD", None, "Canada"), ("BRK.B", "USD", "US", "United States"), ("VOD.L", "GBP", "London", "United Kingdom"), ("AAPL", "USD", "US", "United States"), ("XX.PA", None, None, None), ("", None, None, None), ("FID-5982", "CAD", None, "Canada"), ("X.CN", "CAD", "TSX", "Canada")]


@query("str17_listing_parts", "with r as (select p_partkey, " + choose_sql("p_partkey", [s[0] for s in SYMBOLS]) + " as s from part) select p_partkey, " + ", ".join(f"{cases_sql('s', [(x[0], x[i]) for x in SYMBOLS])} as {n}" for i, n in ((1, "currency"), (2, "exchange"), (3, "region"))) + " from r")
def _(t: Tables) -> DataFrame:
    v = labels.listing(choose(F.col("p_partkey"), [s[0] for s in SYMBOLS]))
    return t.part.select("p_partkey", v.alias("v")).select("p_partkey", "v.*")


@query("str20_between_marks", "select p_partkey, ' ' || p_name || ' ' as part from part where p_size % 2 = 0 union all select p_partkey, case when p_size % 3 = 0 then null else ' ' || p_name end from part where p_size % 2 = 1")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Intro TOP HOLDINGS "), "p_name", F.lit(" Sector allocation x"))).when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("top  holdings "), "p_name"))
    return t.part.select("p_partkey", labels.between_marks(text, r"top\s+holdings", r"sector\s+allocation").alias("part"))


@query("joi19_same_listing", """with s as (select n_nationkey as k, case n_nationkey % 5 when 0 then 'RY.TO' when 1 then 'RY' when 2 then 'BRK/B' when 3 then 'brk.b' else 'N/A' end as s from nation)
select a.k as a, b.k as b from s a join s b on a.k < b.k where (a.s = b.s and a.s <> 'N/A') or (a.s in ('BRK/B', 'brk.b') and b.s in ('BRK/B', 'brk.b'))""")
def _(t: Tables) -> DataFrame:
    s = t.nation.select(F.col("n_nationkey").alias("k"), choose(F.col("n_nationkey"), ["RY.TO", "RY", "BRK/B", "brk.b", "N/A"]).alias("s"))
    s = s.withColumn("c", labels.canonical_ticker(F.col("s"))).where("c is not null")
    a, b = (s.select(F.col("k").alias(x), F.col("s").alias(f"s{x}"), "c") for x in "ab")
    return a.join(b, "c").where((F.col("a") < F.col("b")) & labels.same_listing(F.col("sa"), F.col("sb"))).select("a", "b")


_INST = "i as (select p_partkey as id, case p_size % 6 when 0 then 'CASH' when 1 then 'RBF' || (100 + p_partkey % 900) when 2 then '' else 'AB' || chr(65 + (p_partkey % 26)::int) end as symbol, case p_partkey % 4 when 0 then 'stock' when 1 then 'etf' when 2 then 'mutualfund' else 'cash' end as type, case when p_size % 2 = 0 then 'auto' else 'manual' end as source, p_size % 5 = 0 as nav from part)"


def instruments(t: Tables) -> DataFrame:
    s, k = F.col("p_size") % 6, F.col("p_partkey")
    symbol = F.when(s == 0, "CASH").when(s == 1, F.concat(F.lit("RBF"), (k % 900 + 100).cast("string"))).when(s == 2, "").otherwise(F.concat(F.lit("AB"), F.char(k % 26 + 65)))
    return t.part.select(
        k.alias("id"), symbol.alias("symbol"), choose(k, ["stock", "etf", "mutualfund", "cash"]).alias("type"), F.when(F.col("p_size") % 2 == 0, "auto").otherwise("manual").alias("source"), (F.col("p_size") % 5 == 0).alias("nav")
    )


@query("fil12_eligible", f"""with {_INST} select id, type in ('stock', 'etf') and symbol not in ('', 'CASH') and symbol not like 'RBF%' as monthly, type in ('stock', 'etf') and symbol <> 'CASH' and source = 'auto' and not nav as refreshable from i""")
def _(t: Tables) -> DataFrame:
    i = instruments(t)
    return i.select("id", labels.priced_monthly(F.col("symbol"), F.col("type")).alias("monthly"), labels.refreshable(F.col("symbol"), F.col("type"), F.col("source"), F.col("nav")).alias("refreshable"))


_QUEUE = """q as (select o_orderkey as id, case when o_orderkey % 5 = 0 then 'running' when o_orderkey % 5 = 1 then 'done' else 'queued' end as status, case when o_orderkey % 5 = 0 then 'w1' end as worker,
  case when o_orderkey % 10 = 0 then cast(o_orderdate as timestamp) end as claimed, cast(o_orderdate as date) as queued_at from orders)"""


def queue(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), F.when(k % 5 == 0, "running").when(k % 5 == 1, "done").otherwise("queued").alias("status"), F.when(k % 5 == 0, "w1").alias("worker"),
        F.when(k % 10 == 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("claimed"), F.to_date("o_orderdate").alias("queued_at"),
    )


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@query("fil14_stale_claims", f"with {_QUEUE} select id from q where status = 'running' and (claimed is null or claimed < timestamp '1996-01-01')")
def _(t: Tables) -> DataFrame:
    return queue(t).where(books.is_stale(F.col("status"), F.col("claimed"), at("1996-01-01"))).select("id")


@query("snk08_claim", f"""with {_QUEUE}, m as (select id from q where status = 'queued' or (status = 'running' and (claimed is null or claimed < timestamp '1996-01-01')) order by queued_at, id limit 50)
select id, case when id in (select id from m) then 'running' else status end as status, case when id in (select id from m) then 'w2' else worker end as worker, case when id in (select id from m) then timestamp '1999-01-01' else claimed end as claimed, queued_at from q""")
def _(t: Tables) -> DataFrame:
    return books.claim(queue(t), "w2", at("1999-01-01"), at("1996-01-01"), 50)


@query("snk08_release", f"""with {_QUEUE}, d as (select id, id % 4 <> 0 as ok from q where id % 3 = 0), x as (select q.*, ok from q left join d using (id)), y as (select *, status = 'running' and worker = 'w1' and ok is not null as mine from x)
select id, case when mine and ok then 'done' when mine then 'queued' else status end as status, case when mine and not ok then null else worker end as worker, case when mine and not ok then null else claimed end as claimed, queued_at from y""")
def _(t: Tables) -> DataFrame:
    q = queue(t)
    return books.release(q, q.where("id % 3 = 0").select("id", (F.col("id") % 4 != 0).alias("ok")), "w1")


@query("snk09_newest_entries", "select o_custkey, o_orderkey, o_orderdate::date as date from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3")
def _(t: Tables) -> DataFrame:
    log = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"))
    return books.newest(log, ["o_custkey"], [F.desc("date"), F.desc("o_orderkey")], 3)


@query("snk10_replace_children", """with s as (select l_orderkey as parent, l_linenumber as child, 'old' as v from lineitem where l_linenumber <= 3), n as (select l_orderkey as parent, l_linenumber as child, 'new' as v from lineitem where l_orderkey % 4 = 0 and l_linenumber <= 2)
select * from s where parent not in (select parent from n) union all select * from n""")
def _(t: Tables) -> DataFrame:
    x = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"))
    return books.replace_children(x.where("child <= 3").withColumn("v", F.lit("old")), x.where("parent % 4 = 0 and child <= 2").withColumn("v", F.lit("new")), "parent")


@query("srt09_backfill_plan", """with r as (select c_custkey, 'S' || c_custkey as symbol, c_custkey % 7 = 0 as complete, c_custkey % 7 = 1 as cooling, count(o_orderkey) as support, max(strftime(o_orderdate, '%Y-%m')) as last_month from customer left join orders on o_custkey = c_custkey group by 1),
p as (select * from r where not complete and not cooling order by support, coalesce(last_month, ''), symbol limit 4)
select symbol, case when complete then 'skipped' when cooling then 'cooling' when symbol in (select symbol from p) then 'fetch' else 'deferred' end as plan from r""")
def _(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("support"), F.max(F.date_format("o_orderdate", "yyyy-MM")).alias("last_month"))
    k = F.col("c_custkey")
    r = t.customer.join(o, k == F.col("o_custkey"), "left").select(F.concat(F.lit("S"), k.cast("string")).alias("symbol"), (k % 7 == 0).alias("complete"), (k % 7 == 1).alias("cooling"), "support", "last_month")
    return books.backfill_plan(r, 4)


@query("srt10_freshness_rank", "select c_custkey, case when d is null then 0 when d < date '1998-06-01' then 1 else 2 end as freshness from customer left join (select o_custkey, max(cast(o_orderdate as date)) as d from orders group by 1) on o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("d"))
    x = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("c_custkey", F.when(F.col("d").isNull(), 0).when(F.col("d") < "1998-06-01", 1).otherwise(2).alias("freshness"))


@query("srt12_digest_order", """with x as (select filing_id || ':' || row_index as id, ticker, disclosed_date, coalesce(ticker in (select p_brand || '-' || p_type from part where p_size = 25), false) as held from trades),
k as (select *, row_number() over (order by held desc, disclosed_date desc nulls last, id) as place from x) select place, id, ticker, held, (select greatest(0, count(*) - 30) from x) as overflow from k where place <= 30""", "trades")
def _(t: Tables) -> DataFrame:
    held = t.part.where("p_size = 25").select(F.concat_ws("-", "p_brand", "p_type").alias("ticker")).distinct()
    x = t.trades.select(F.concat_ws(":", "filing_id", "row_index").alias("id"), "ticker", "disclosed_date")
    return books.digest(x, held)


_YEARS = "p as (select n_name as key, 1985 + (n_nationkey * 7 + k) % 40 as year, k % 3 = 0 as ytd, case when k <> 4 then k / 8.0::double end as value from nation, range(6) as r(k)), f as (select n_name as key, 1985 + (n_nationkey * 7 + k + 2) % 40 as year, k % 3 = 1 as ytd, -k / 8.0::double as value from nation, range(6) as r(k))"


@query("set07_calendar_years", f"with {_YEARS}, u as (select 0 as rank, * from p union all select 1, * from f) select key, year, ytd, arg_min(value, rank) as value from u where year between 1990 and 2100 and value is not null group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    n = t.nation.crossJoin(t.spark.range(6).withColumnRenamed("id", "k"))  # six rows for each nation make the fixture
    year = lambda d: (F.col("n_nationkey") * 7 + F.col("k") + d) % 40 + 1985
    p = n.select(F.col("n_name").alias("key"), year(0).alias("year"), (F.col("k") % 3 == 0).alias("ytd"), F.when(F.col("k") != 4, F.col("k") / 8.0).alias("value"))
    return books.calendar_years(p, n.select(F.col("n_name").alias("key"), year(2).alias("year"), (F.col("k") % 3 == 1).alias("ytd"), (-F.col("k") / 8.0).alias("value")))


def _published(t: Tables, shift: int) -> DataFrame:
    k = F.col("n_nationkey")
    figures = [F.when((k + i + shift) % 4 == 0, (k + i) / F.lit(100.0)).alias(c) for i, c in enumerate(books.PUBLISHED)]
    return t.nation.where(k % 5 != shift).select(F.col("n_name").alias("key"), F.when(k % 3 == shift, F.lit("2024-01-31")).alias("as_of"), *[F.when(k % 7 != 0, f).alias(c) for f, c in zip(figures, books.PUBLISHED, strict=True)])


def _published_sql(shift: int) -> str:
    figures = ", ".join(f"case when n_nationkey % 7 <> 0 and (n_nationkey + {i + shift}) % 4 = 0 then (n_nationkey + {i}) / 100.0::double end as {c}" for i, c in enumerate(books.PUBLISHED))
    return f"(select n_name as key, case when n_nationkey % 3 = {shift} then '2024-01-31' end as as_of, {figures} from nation where n_nationkey % 5 <> {shift})"


@query("fin29_published_returns", f"select * from (select key, coalesce(a.as_of, b.as_of) as as_of, {', '.join(f'coalesce(a.{c}, b.{c}) as {c}' for c in books.PUBLISHED)} from {_published_sql(0)} a full join {_published_sql(1)} b using (key)) where coalesce({', '.join(books.PUBLISHED)}) is not null")
def _(t: Tables) -> DataFrame:
    return books.published_periods(_published(t, 0), _published(t, 1))


@query("agg20_look_through_coverage", """with h as (select model_key, instrument, weight, case n_nationkey % 3 when 0 then 'etf' when 1 then 'stock' else 'mutualfund' end as type, case when n_nationkey % 4 <> 1 then n_regionkey else 0 end as parts,
  case when n_nationkey % 5 <> 2 then date '2024-01-01' + cast(n_nationkey as int) end as as_of from version_holdings join nation on n_name = instrument)
select model_key, round(sum(case when parts > 0 then weight else 0 end) / sum(weight), 8) as look_through, count(*) filter (parts = 0) as single_bucket, min(as_of) filter (parts > 0) as oldest_as_of,
  coalesce(list_sort(list(instrument) filter (parts > 0 and as_of is null)), []) as missing_as_of, coalesce(list_sort(list(instrument) filter (parts = 0 and type in ('etf', 'mutualfund'))), []) as missing_breakdown,
  count(*) filter ((parts > 0 and as_of is null) or (parts = 0 and type in ('etf', 'mutualfund'))) > 0 as issues from h group by 1""", "version_holdings")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    n = t.nation.select(F.col("n_name").alias("instrument"), choose(k, ["etf", "stock", "mutualfund"]).alias("type"), F.when(k % 4 != 1, F.col("n_regionkey")).otherwise(0).alias("parts"), F.when(k % 5 != 2, F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))).alias("as_of"))
    out = books.look_through_coverage(t.version_holdings.join(n, "instrument"), ["model_key"])
    return out.withColumn("look_through", F.round("look_through", 8))


@query("agg29_current_holdings", """with c as (select * from version_holdings where (model_key, effective_date) in (select (model_key, max(effective_date)) from version_holdings group by model_key))
select instrument, list_sort(list({'model_key': model_key, 'weight': weight})) as models from c group by 1""", "version_holdings")
def _(t: Tables) -> DataFrame:
    last = t.versions.groupBy("model_key").agg(F.max("effective_date").alias("effective_date"))
    c = t.version_holdings.join(last, ["model_key", "effective_date"], "left_semi")
    return c.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("model_key", "weight"))).alias("models"))


@query("agg27_annual_coverage", """with c as (select * from filings qualify row_number() over (partition by person_key order by year(filed_date) desc, filed_date desc, filing_id desc) = 1)
select count(*) as people, count(*) filter (parse_status = 'parsed') as parsed, count(*) filter (parse_status = 'partial') as partial, count(*) filter (parse_status = 'needs_manual_review') as unreadable from c""", "filings")
def _(t: Tables) -> DataFrame:
    newest = t.filings.groupBy("person_key").agg(F.max_by("parse_status", F.struct("filed_date", "filing_id")).alias("s"))
    n = lambda s: F.count_if(F.col("s") == s)
    return newest.agg(F.count("*").alias("people"), n("parsed").alias("parsed"), n("partial").alias("partial"), n("needs_manual_review").alias("unreadable"))


@query("jsn04_merge_patch", """with c as (select n_nationkey as id, [n_name] as parts, date '2024-01-01' as as_of from nation), p as (select n_nationkey as id, case n_nationkey % 4 when 0 then ['x', 'y'] when 1 then [] when 2 then ['z'] end as parts, case when n_nationkey % 4 <> 2 then date '2024-02-02' end as as_of from nation where n_nationkey % 3 <> 0),
x as (select c.id, c.parts as cp, c.as_of as ca, p.parts as pp, p.as_of as pa, case when p.id is null or p.parts is null then 'kept' when len(p.parts) = 0 then 'cleared' when p.as_of is null then 'refused' else 'replaced' end as status from c left join p using (id))
select id, case status when 'replaced' then pp when 'cleared' then null else cp end as parts, case status when 'replaced' then pa when 'cleared' then null else ca end as as_of, status from x""")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    day = lambda s: F.lit(s).cast("date")
    parts = F.when(k % 4 == 0, F.array(F.lit("x"), F.lit("y"))).when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("z")))
    patch = t.nation.where(k % 3 != 0).select(k.alias("id"), parts.alias("parts"), F.when(k % 4 != 2, day("2024-02-02")).alias("as_of"))
    return books.merge_patch(t.nation.select(k.alias("id"), F.array("n_name").alias("parts"), day("2024-01-01").alias("as_of")), patch, "id")


@query("jsn02_nested_documents", """select r_name as region, len(list(n_name)) as n, list_sort(list({'name': n_name, 'key': n_nationkey})) as nations from region join nation on r_regionkey = n_regionkey group by 1""")
def _(t: Tables) -> DataFrame:
    x = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("region"))
    doc = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))).alias("nations")))
    back = F.from_json("doc", "nations array<struct<name:string,key:bigint>>")["nations"]
    return x.agg(doc.alias("doc")).select("region", F.size(back).cast("long").alias("n"), back.alias("nations"))


@query("dat12_range_start", "select symbol, max(date) - 365 as y1, max(date) - 730 as y2, max(date) - 1825 as y5 from daily_points group by 1", "daily_points")
def _(t: Tables) -> DataFrame:
    d = t.daily_points.groupBy("symbol").agg(F.max("date").alias("d"))
    return d.select("symbol", *[F.date_sub("d", n).alias(c) for c, n in (("y1", 365), ("y2", 730), ("y5", 1825))])


@query("dat13_today_in_zone", "select event_id, cast((k.at at time zone 'UTC') at time zone 'America/New_York' as date) as new_york from (select event_id, ts + to_days(cast(event_id % 366 as int)) as at from events) k")
def _(t: Tables) -> DataFrame:
    """Stamps are UTC, over the whole year: New York is five hours behind, in summer four."""
    moved = F.col("ts").cast("timestamp_ntz") + F.make_interval(days=(F.col("event_id") % 366).cast("int"))
    return t.events.select("event_id", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), moved)).alias("new_york"))


@query("mth06_rounding", "select o_orderkey, round(o_totalprice::varchar::decimal(38,12), 1)::double as one, round(o_totalprice::varchar::decimal(38,12), 0)::double as whole from orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", money.half_up(F.col("o_totalprice"), 1).alias("one"), money.half_up(F.col("o_totalprice")).alias("whole"))


@query("map01_group_lookup", "select o_custkey, count(*) filter (o_orderpriority = '1-URGENT') as urgent, count(*) filter (o_orderpriority = '5-LOW') as low from orders group by 1")
def _(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    m = g.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return m.select("o_custkey", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(c) for c, k in (("urgent", "1-URGENT"), ("low", "5-LOW"))])


@query("joi18_first_match", "select c_custkey, (select min(s_suppkey) from supplier where s_nationkey = c_nationkey) as s_suppkey from customer")
def _(t: Tables) -> DataFrame:
    """One partner each: the first by key where several fit, null where none does."""
    first = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    return t.customer.join(first, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_custkey", "s_suppkey")


@query("rec20_best_filing", "select person_key, filing_id, filed_date, parse_status from filings qualify row_number() over (partition by person_key order by filed_date desc nulls last, case parse_status when 'parsed' then 0 when 'partial' then 1 else 2 end, filing_id desc) = 1", "filings")
def _(t: Tables) -> DataFrame:
    good = F.when(F.col("parse_status") == "parsed", 2).when(F.col("parse_status") == "partial", 1).otherwise(0)
    best = t.filings.groupBy("person_key").agg(F.max_by(F.struct("filing_id", "filed_date", "parse_status"), F.struct("filed_date", good, "filing_id")).alias("f"))
    return best.select("person_key", "f.*")

