"""Queries on stored filings, digests that are sent once, merged states and names that are matched again."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inputs, money
from ..operators import disclosures, filings, ledger, writes
from ..sources.kept import kept, spread
from ..sources.tables import Tables
from .entities import NAMES, TICKER, _by_name, entity_tables, written
from .registry import query


def heads(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    n = F.col("o_orderkey") % 4
    return o.select(
        F.when(n < 2, "house").otherwise("senate").alias("source"), F.col("o_orderkey").cast("string").alias("filing_key"), F.when(n == 3, "").otherwise(F.concat(F.lit(" Jörg  "), F.left("c_mktsegment", F.lit(3)))).alias("first"),
        F.when(n == 3, "").otherwise(F.col("c_name")).alias("last"), F.when(n < 2, "house").otherwise("senate").alias("office"), F.when(n == 1, "candidate").alias("filer_status"), F.lit(None).cast("string").alias("party"),
        F.when(F.col("o_orderstatus") != "P", F.lower("o_orderstatus")).alias("status"), F.to_date("o_orderdate").alias("filed_date"), F.when(n == 2, "amendment").when(n == 1, "other").alias("kind"), F.when(n > 0, n).alias("excluded"), F.lit(None).cast("long").alias("unreadable"),
    )


_HEADS = """h as (select o_orderkey as k, o_orderkey % 4 as n, case when o_orderkey % 4 < 2 then 'house' else 'senate' end as source, lower(left(c_mktsegment, 3)) as seg, c_mktsegment, c_name, o_orderstatus, o_orderdate::date as filed_date from orders join customer on o_custkey = c_custkey)"""
_KEY = "case when n = 3 then source else source || ':' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || ':jorg' end"
_NAME = "case when n = 3 then 'Unknown' else 'Jörg ' || left(c_mktsegment, 3) || ' ' || c_name end"
_STATUS = "case when o_orderstatus = 'P' then 'needs_manual_review' else lower(o_orderstatus) end"


@query("rec01_filing_records", f"with {_HEADS} select source || ':' || k as id, {_KEY} as person_key, {_NAME} as person_name, case when n = 1 then 'candidate' when n >= 2 then 'member' end as filer_status, {_STATUS} as status from h")
def _(t: Tables) -> DataFrame:
    return filings.filing_records(heads(t)).select("id", "person_key", "person_name", "filer_status", "status")


@query("rec02_annual_filings", f"with {_HEADS} select 'annual:' || source || ':' || k as id, {_KEY} as person_key, case when n = 2 then 'amendment' else 'original' end as kind, n as excluded, 0::bigint as unreadable, {_STATUS} as status from h")
def _(t: Tables) -> DataFrame:
    return filings.filing_records(heads(t), annual=True).select("id", "person_key", "kind", "excluded", "unreadable", "status")


@query("rec01_trade_rows", f"""with {_HEADS}, l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as nth from lineitem)
select source || ':' || k || ':' || nth as id, source || ':' || k as filing_id, nth::int as row_index, {_KEY} as person_key, case when l_partkey % 3 = 0 then 'AB' when l_partkey % 3 = 1 then 'N/A' end as ticker, case when l_partkey % 3 = 0 then 'AB' end as ticker_norm,
case when l_partkey % 5 = 0 then 'name_match' when l_partkey % 3 < 2 then 'filing' end as ticker_source, case when l_quantity > 40 then null else least(100, greatest(0, round(l_quantity * 4 - 20)))::int end as confidence, (filed_date - l_shipdate::date)::int as lag_days
from l join h on l_orderkey = k""")
def _(t: Tables) -> DataFrame:
    records = filings.filing_records(heads(t))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    source = F.when(F.col("l_orderkey") % 4 < 2, "house").otherwise("senate")
    p = F.col("l_partkey") % 3
    trades = t.lineitem.select(
        F.concat_ws(":", source, "l_orderkey").alias("id"), (F.row_number().over(order) * 10).alias("nth"), F.when(p == 0, "AB").when(p == 1, "N/A").alias("ticker"), F.lit("x").alias("class"), F.lit(None).cast("boolean").alias("partial"),
        F.to_date("l_shipdate").alias("date"), F.when(F.col("l_partkey") % 5 == 0, "name_match").alias("ticker_source"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity") * 4 - 20).alias("confidence"),
    )
    return filings.trade_rows(records, trades).select("id", "filing_id", "row_index", "person_key", "ticker", "ticker_norm", "ticker_source", "confidence", "lag_days")


@query("rec04_filers", """select c_custkey, case when c_custkey % 5 = 0 then 'officer' when c_custkey % 5 in (1, 2) then 'member' else 'candidate' end as filer, case when c_custkey % 3 = 0 then 'NY' end as state, case when c_custkey % 3 = 0 then lpad((c_custkey % 60)::varchar, 2, '0') end as district from customer""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    printed = F.when(k % 5 == 0, " Officer ").when(k % 5 == 3, "spouse")
    district = F.when(k % 3 == 0, F.concat(F.lit("NY"), F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 3 == 1, "NY1")
    return t.customer.select("c_custkey", filings.filer_status(printed, F.when(k % 5 == 1, "HON."), k % 5 == 2).alias("filer"), filings.state_of(district).alias("s")).select("c_custkey", "filer", "s.*")


_CLASSES = ["stock", "other", "bond", "etf_fund", "other"]


@query(
    "rec02_holding_tickers",
    f"""with h as (select p_partkey, case when p_partkey % 7 = 0 then 'AB' when p_partkey % 5 = 2 or p_partkey % 11 = 0 then null else {TICKER} || {_by_name([n[5] for n in NAMES], 'varchar')} end as ticker, {_by_name([n[4] for n in NAMES], 'int')} as conf, {_by_name([n[1] for n in NAMES], 'varchar')} as found from part)
select p_partkey as id, ticker, case when ticker is null then null when p_partkey % 7 = 0 then 'filing' else 'name_match' end as ticker_source, case when ticker is not null and p_partkey % 7 <> 0 then conf end as confidence,
case when p_partkey % 5 not in (1, 4) then {_by_name(_CLASSES, 'varchar')} when ticker is null or p_partkey % 7 = 0 then 'other' when found = 'etf' then 'etf_fund' else found end as class from h""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = spread(t.part.select("p_partkey")).select(
        k.alias("id"), F.expr(written([n[0] for n in NAMES])).alias("asset"), F.when(k % 7 == 0, "ab").when(k % 7 == 1, "--").alias("ticker"), F.element_at(F.array(*map(F.lit, _CLASSES)), (k % 5 + 1).cast("int")).alias("class"), F.when(k % 11 == 0, "OP").otherwise("ST").alias("code")
    )
    return filings.annotated_holdings(rows, **entity_tables(t)).select("id", "ticker", "ticker_source", "confidence", "class")


SINCE = date(1995, 6, 1)


@query("stm06_digest_states", f"""with x as (select filing_id || ':' || row_index as id, tx_date as created, disclosed_date as disclosed, row_index % 3 <> 1 as pending, filing_id % 5 = 0 as sent from trades),
d as (select id from x where not sent and created >= date '{SINCE}' and pending order by disclosed desc nulls last, id desc limit {ledger.SHOWN})
select id, case when sent then 'sent' when created < date '{SINCE}' then 'historical' when id in (select id from d) then 'due' when pending then 'waiting' else 'none' end as state from x""", "trades")
def _(t: Tables) -> DataFrame:
    x = t.trades.select(F.concat_ws(":", "filing_id", "row_index").alias("id"), F.col("tx_date").alias("created"), F.col("disclosed_date").alias("disclosed"), (F.col("row_index") % 3 != 1).alias("pending"), "filing_id")
    sent = x.where("filing_id % 5 = 0").select("id")
    return ledger.digest_states(x.drop("filing_id"), sent.unionByName(sent), SINCE)


@query("stm07_merged_branches", """with b as (select o_orderkey as key, o_totalprice as value from orders where o_orderkey % 9 <> 8), o as (select key, case when key % 5 = 0 then value + 1 else value end as value from b where key % 7 <> 1 union all select o_orderkey, 5.0 from orders where o_orderkey % 9 = 8),
t as (select key, case when key % 4 = 0 then value + 2 else value end as value from b where key % 11 <> 2)
select key, value, false as conflict from (select o.key, o.value from o left join b using (key) where b.key is null) union all
select b.key, case when t.key is null or t.value <> b.value then t.value else o.value end, ((o.key is null or o.value <> b.value) and (t.key is null or t.value <> b.value) and not (o.key is null and t.key is null))
from b left join o using (key) left join t using (key) where (case when t.key is null or t.value <> b.value then t.key else o.key end) is not null or ((o.key is not null and o.value <> b.value) and t.key is null)""")
def _(t: Tables) -> DataFrame:
    """Ours changes every fifth, deletes and adds some; theirs changes every fourth and deletes others."""
    o = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    base, k = o.where("key % 9 <> 8"), F.col("key")
    ours = base.where("key % 7 <> 1").withColumn("value", F.when(k % 5 == 0, F.col("value") + 1).otherwise(F.col("value"))).unionByName(o.where("key % 9 = 8").withColumn("value", F.lit(5.0)))
    theirs = base.where("key % 11 <> 2").withColumn("value", F.when(k % 4 == 0, F.col("value") + 2).otherwise(F.col("value")))
    return ledger.merge_branches(base, ours, theirs, ["key"], "value")


FETCHED = date(2024, 3, 1)


@query(
    "fin33_rematched",
    f"""with r as (select p_partkey as id, p_partkey % 5 as k, {TICKER} || {_by_name([n[5] for n in NAMES], 'varchar')} as found, {_by_name([n[4] for n in NAMES], 'int')} as conf from part)
select id, case when k = 0 then 'OLD' when k in (2, 3, 4) then found end as ticker, case when k in (0, 1) then 'filing' when k in (2, 3, 4) and found is not null then 'name_match' end as ticker_source, case when k in (2, 3, 4) then conf end as confidence,
case when k in (2, 3, 4) then date '{FETCHED}' when k = 1 then date '2020-01-01' end as matched_at, case when k in (2, 3, 4) then {ledger.MATCHER_VERSION} end::int as matched_by from r""",
)
def _(t: Tables) -> DataFrame:
    """By part: a printed ticker; none, as the filing says; matched before the catalog; by an older matcher; never."""
    k = F.col("p_partkey") % 5
    stored = spread(t.part.select("p_partkey")).select(
        F.col("p_partkey").alias("id"), F.expr(written([n[0] for n in NAMES])).alias("asset"), F.when(k == 0, "OLD").alias("ticker"), F.when(k < 2, "filing").alias("ticker_source"), F.lit(None).cast("int").alias("confidence"),
        F.when(k.isin(1, 2), F.lit(date(2020, 1, 1))).when(k == 3, F.lit(date(2024, 3, 5))).alias("matched_at"), F.when(k == 2, ledger.MATCHER_VERSION).when(k == 3, ledger.MATCHER_VERSION - 1).alias("matched_by"),
    )
    return ledger.rematched(stored, FETCHED, **entity_tables(t)).drop("asset")


#: What is typed, by event: as it is, with marks, and in ways that are no share or value. SQL of both engines.
TYPED = "case cast(event_id % 9 as int) when 0 then cast(cast(value as decimal(12,2)) as varchar(20)) when 1 then concat(' $', cast(cast(value as decimal(12,2)) as varchar(20)), ' ') when 2 then '' when 3 then '-' when 4 then '0' when 5 then '0.004' when 6 then 'abc' when 7 then '-5' else '99.996' end"
_SHARE = f"""case cast(event_id % 9 as int) when 0 then case when cast(value as decimal(12,2)) > 100 then '{inputs.OUT_OF_RANGE}' when cast(value as decimal(12,2)) = 0 then '{inputs.NEEDS_SHARE}' end when 1 then '{inputs.NO_NUMBER}' when 2 then '{inputs.NEEDS_SHARE}' when 3 then '{inputs.NEEDS_SHARE}'
 when 4 then '{inputs.NEEDS_SHARE}' when 5 then '{inputs.TOO_SMALL}' when 6 then '{inputs.NO_NUMBER}' when 7 then '{inputs.OUT_OF_RANGE}' end"""


@query("str24_nav_inputs", f"""select event_id, event_id % 9 = 2 as empty, case when event_id % 9 in (0, 1) and cast(value as decimal(12,2)) > 0 then cast(value as decimal(12,2))::double when event_id % 9 = 5 then 0.004 when event_id % 9 = 8 then 99.996 end as value,
case when event_id % 9 in (3, 6, 7) then '{inputs.NAV_NUMBER}' when event_id % 9 = 4 or (event_id % 9 in (0, 1) and cast(value as decimal(12,2)) = 0) then '{inputs.NAV_POSITIVE}' end as error from events""")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", inputs.nav_input(F.expr(TYPED)).alias("i")).select("event_id", "i.*")


@query("str24_gates", f"""with m as (select event_id, event_type, value, {_SHARE} as message from events)
select event_id, message is null as valid, case when message is null then case when event_id % 9 = 8 then 100.0 else cast(value as decimal(12,2))::double end when event_id % 9 = 5 then 0.004 when message = '{inputs.NEEDS_SHARE}' and event_id % 9 in (0, 4) then 0.0 end as value,
case when event_type <> 'view' then coalesce(message, case when event_type = 'error' then '{inputs.NEEDS_TICKER}' when event_type = 'click' then '{inputs.NO_TICKER}' end) end as preview,
coalesce(message, case when event_type = 'signup' then '{inputs.HAS_CASH}' when event_type = 'click' then '{inputs.HAS_SYMBOL}' when event_type = 'error' then '{inputs.NEEDS_NAME}' when event_type = 'view' then '{inputs.UNFUNDED}' end) as adding from m""")
def _(t: Tables) -> DataFrame:
    raw, kind = F.expr(TYPED), F.col("event_type")
    symbol = F.when(kind == "click", "two words").when(kind != "error", "ab")
    share = t.events.select("event_id", "event_type", inputs.allocation(raw).alias("a"), inputs.preview_gate(kind != "view", raw, symbol, F.lit(False)).alias("preview"), inputs.add_gate(raw, kind == "signup", kind == "click", kind == "error", kind != "view", F.lit(None).cast("string")).alias("adding"))
    return share.select("event_id", "a.valid", "a.value", "preview", "adding")


def stored_series(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every symbol's days as JSON under three names, days twice and days that are none; points of some are stored already."""
    d = t.daily_points.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    name = F.when(F.col("n") % 3 == 0, "close").when(F.col("n") % 3 == 1, "price").otherwise("nav")
    item = lambda x: F.concat(F.lit('{"date":"'), F.date_format("date", "yyyy-MM-dd"), F.when(F.col("n") % 7 == 0, "T00").otherwise(""), F.lit('","'), name, F.lit('":"'), x, F.lit('"}'))
    both = d.select(F.lower("symbol").alias("symbol"), "n", F.explode(F.array(F.struct(F.lit(0).alias("k"), item(F.when(F.col("n") % 5 == 0, "x").otherwise(F.col("close").cast("decimal(18,2)").cast("string"))).alias("e")), F.struct(F.lit(1).alias("k"), item(F.lit("7.5")).alias("e")))).alias("v"))
    series = both.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v.k", "v.e"))), lambda s: s["e"]).alias("series"))
    return series, d.where("n % 4 = 0").select(F.upper("symbol").alias("symbol"), "date", F.lit(1.0).alias("close"))


@query("snk11_moved_points", """with d as (select upper(symbol) as key, *, row_number() over (partition by symbol order by date) as n from daily_points)
select key as symbol, date, case when n % 5 = 0 or close::decimal(18,2) <= 0 then 7.5::double else close::decimal(18,2)::double end as close from d where n % 7 <> 0 and n % 4 <> 0""", "daily_points")
def _(t: Tables) -> DataFrame:
    return writes.migrate_series(*stored_series(t))[0]


_BOUND = "case when row_index % 6 = 5 then 'undetermined' when low is null then 'unreadable' when high is null then 'at_least' else 'range' end"
_SHOWN = f"""with k as (select *, parse_status = 'needs_manual_review' as bad, year(filed_date) as y from filings), w as (select *, row_number() over (partition by person_key order by filed_date desc, filing_id desc) as j, row_number() over (partition by person_key, y, bad order by filed_date desc, filing_id desc) as jy from k),
now as (select n.person_key, coalesce(case when n.bad then r.filing_id end, n.filing_id) as filing_id, coalesce(case when n.bad then r.parse_status end, n.parse_status) as parse_status, n.bad as newer_unreadable from (select * from w where j = 1) n left join (select * from w where jy = 1 and not bad) r on r.person_key = n.person_key and r.y = n.y),
h as (select now.person_key, asset_class as class, {_BOUND} as bound, low, high, case when high is not null then floor((low + high) / 2.0 + 0.5)::bigint else low end as mid from now join bounded using (filing_id) where parse_status <> 'needs_manual_review'),
v as (select * from h where bound in ('range', 'at_least'))"""


@query("fin30_presented_totals", f"""{_SHOWN}, t as (select person_key, count(*) filter (bound in ('range', 'at_least')) as n, sum(low) filter (bound in ('range', 'at_least'))::bigint as low, case when count(*) filter (bound = 'at_least') = 0 then sum(high) filter (bound = 'range') end::bigint as high,
sum(mid) filter (bound in ('range', 'at_least'))::bigint as mid, count(*) filter (bound = 'undetermined') as undetermined from h group by 1)
select person_key, case when parse_status = 'needs_manual_review' then 'unreadable' else parse_status end as status, filing_id, newer_unreadable, case when parse_status <> 'needs_manual_review' then coalesce(n, 0) end as n, case when parse_status <> 'needs_manual_review' then coalesce(low, 0) end as low,
case when n is null and parse_status <> 'needs_manual_review' then 0 else high end as high, case when parse_status <> 'needs_manual_review' then coalesce(mid, 0) end as mid, case when parse_status <> 'needs_manual_review' then coalesce(undetermined, 0) end as undetermined from now left join t using (person_key)""", "filings bounded")
def _(t: Tables) -> DataFrame:
    return presented(t)[0]


@query("fin30_presented_classes", f"{_SHOWN} select person_key, class, count(*) as n, sum(low)::bigint as low, sum(mid)::bigint as mid, round(sum(mid) / sum(sum(mid)) over (partition by person_key), 9) as share from v group by 1, 2", "filings bounded")
def _(t: Tables) -> DataFrame:
    return presented(t)[1].withColumn("share", F.round("share", 9))


def presented(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each person's current filing is found first, and only its lines are made holdings."""
    now = kept(disclosures.current_filing(t.filings), "current")
    return disclosures.presented(now, annual_holdings(t, now))


def annual_holdings(t: Tables, filings: DataFrame) -> DataFrame:
    """The lines of some filings as their holdings; every sixth has no determined value."""
    x = disclosures.with_bounds(t.trades_of(filings))
    return x.select("filing_id", F.col("asset_class").alias("class"), F.expr(_BOUND).alias("bound"), "low", "high", F.coalesce(money.middle(F.col("low"), F.col("high")), F.col("low")).alias("mid"))
