"""Queries on extraction, matching, writes and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import extract, names, writes
from ..sources.kept import spread
from ..sources.tables import Tables
from ..streaming import alerts
from .registry import query

DRAW = "ev as (select symbol as key, date::timestamp as ts, close / max(close) over (partition by symbol order by date) - 1 as drawdown from daily_points)"


def drawdowns(t: Tables) -> DataFrame:
    peak = F.max("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return t.daily_points.select(F.col("symbol").alias("key"), F.col("date").cast("timestamp_ntz").alias("ts"), (F.col("close") / peak - 1).alias("drawdown"))


@query("stm01_breach_replay", f"""with {DRAW}, s as (select *, case when 100 * drawdown <= -50 + 1e-9 then 1 when 100 * drawdown > -48 + 1e-9 then 0 end as st from ev),
o as (select *, coalesce(last_value(st ignore nulls) over (partition by key order by ts rows unbounded preceding), 0) as now from s), p as (select *, coalesce(lag(now) over (partition by key order by ts), 0) as was from o),
a as (select *, case when now = 1 and was = 0 then 'open' when now = 0 and was = 1 then 'recover' when now = 1 then 'update' else 'none' end as action from p)
select key, ts, round(drawdown, 8) as drawdown, action, (sum(case when action = 'open' then 1 else 0 end) over (partition by key order by ts))::bigint as episode from a""", "daily_points")
def _(t: Tables) -> DataFrame:
    return alerts.replay(drawdowns(t), 0.5).withColumn("drawdown", F.round("drawdown", 8))


_CHECK = """pv as (select symbol as key, case when ascii(symbol) % 2 = 0 then 'active' else 'recovered' end as status, date '2023-12-01' as opened from (select distinct symbol from daily_points)),
lt as (select symbol as key, max(date) as seen, arg_max(close, date) as last, max(close) as peak from daily_points group by 1), ev as (select key, last / peak - 1 as drawdown, seen, length(key) % 3 = 0 as stale from lt),
x as (select coalesce(pv.key, ev.key) as key, pv.status as was, opened, drawdown, seen, stale, coalesce(pv.key, ev.key) not in (select min(key) from lt) as held from pv full join ev on pv.key = ev.key)"""


@query("stm02_check", f"""with {_CHECK} select key, case when not held and was = 'active' then 'closed' when not held then was when was = 'active' and 100 * drawdown > -48 + 1e-9 then 'recovered' when was = 'active' then 'active' when 100 * drawdown <= -50 + 1e-9 and not stale then 'active' else was end as status,
case when not held and was = 'active' then 'close' when not held then 'none' when was = 'active' and 100 * drawdown > -48 + 1e-9 then 'recover' when was = 'active' then 'update' when 100 * drawdown <= -50 + 1e-9 and stale then 'blocked' when 100 * drawdown <= -50 + 1e-9 then 'open' else 'none' end as action,
case when was = 'active' and held then opened when held and 100 * drawdown <= -50 + 1e-9 and not stale then seen else opened end as opened from x""", "daily_points")
def _(t: Tables) -> DataFrame:
    d = t.daily_points.groupBy(F.col("symbol").alias("key")).agg(F.max("date").alias("at"), F.max_by("close", "date").alias("last"), F.max("close").alias("peak"))
    evaluated = d.select("key", (F.col("last") / F.col("peak") - 1).alias("drawdown"), "at", (F.length("key") % 3 == 0).alias("stale"))
    prev = d.select("key", F.when(F.ascii("key") % 2 == 0, "active").otherwise("recovered").alias("status"), F.lit("2023-12-01").cast("date").alias("opened"))
    held = d.select("key").join(d.agg(F.min("key").alias("key")), "key", "left_anti")
    return alerts.check(prev, evaluated, held, 0.5)


@query("stm03_event_windows", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(t: Tables) -> DataFrame:
    return alerts.event_windows(t.events).withColumn("total", F.round("total", 4))


@query("ext09_price_paste", """with x as (select c_custkey as id, date '2020-01-01' + cast(c_custkey % 300 as int) as date, 10 + c_custkey % 7 as close from customer)
select id, date, close::double as close from x union all select id, date + 1, close + 1.5::double from x""")
def _(t: Tables) -> DataFrame:
    d = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int"))
    close = 10 + F.col("c_custkey") % 7
    row = lambda day, c: F.concat_ws("\t", F.date_format(day, "MMM d, yyyy"), F.lit("1"), F.lit("2"), F.lit("3"), c.cast("string"), F.lit("1,000"))
    text = F.concat_ws("\n", F.lit("Date\tOpen\tHigh\tLow\tClose\tVolume"), row(d, close), row(F.date_add(d, 1), close + F.lit(99)), row(F.date_add(d, 1), close + F.lit(1.5)), F.lit("Currency in USD"))
    return extract.price_history(spread(t.customer.select("c_custkey")).select(F.col("c_custkey").alias("id"), text.alias("text")))[0]


@query("ext03_numbered_trades", "select p_partkey as id, 1::bigint as row, p_name as asset, case when p_size % 2 = 0 then 'purchase' else 'sale' end as side, date '2024-03-09' as date, '$1,001 - $15,000' as amount, p_size % 3 <> 0 as reliable from part")
def _(t: Tables) -> DataFrame:
    side = F.when(F.col("p_size") % 2 == 0, "Purchase").otherwise("Sale")
    # One row in four is wrapped before its date, and a page break follows.
    wrap = F.when(F.col("p_size") % 4 == 0, "\n").otherwise(" ")
    good = F.concat(F.lit("1 "), "p_name", F.lit(" "), side, wrap, F.lit("3/9/2024 No $1,001 - $15,000\nPage 1 of 2"))
    bad = F.when(F.col("p_size") % 3 == 0, "2 something ourchasc 3/9/2024 $15,001")
    return extract.numbered_trades(t.part.select(F.col("p_partkey").alias("id"), F.concat_ws("\n", F.lit("Filer: A"), good, bad).alias("text")))


@query("ext09_labelled_percents", "select c_custkey as id, 'Health Care' as label, c_custkey % 90 + 0.5::double as percent from customer union all select c_custkey, 'Energy', 3 from customer")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Sector weights\n  Health Care   "), (F.col("c_custkey") % 90 + F.lit(0.5)).cast("string"), F.lit(" %\nEnergy 3%\nAs of 2024\n"))
    return t.customer.select(F.col("c_custkey").alias("id"), F.inline(extract.labelled_percents(text)))


_SENATE = ["Purchase", "Sale (Full)", "Sale (Partial)", "Exchange", "Gift"]


@query("ext02_html_trades", """select n_nationkey as id, 1 as row, case n_nationkey % 3 when 0 then 'self' when 1 then 'spouse' else 'unknown' end as owner, case when n_nationkey % 2 = 0 then 'AB' || chr(65 + n_nationkey::int) end as ticker, n_name as asset, 'Stock' as kind,
case n_nationkey % 5 when 0 then 'buy' when 1 then 'sell' when 2 then 'sell' when 3 then 'exchange' end as side, n_nationkey % 5 = 2 as partial, date '2024-03-01' + cast(n_nationkey as int) as date, case when n_nationkey % 4 <> 0 then '$1,001 - $15,000' end as amount from nation""")
def _(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    heads = F.lit("<table><tr><th>x</th></tr><tr><td>other</td></tr></table><table><tr><th>#</th><th>Transaction Date</th><th>Owner</th><th>Ticker</th><th>Asset Name</th><th>Asset Type</th><th>Type</th><th>Amount</th><th>Comment</th></tr>")
    row = F.concat(
        F.lit("<tr><td>1</td>"), cell(F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), k.cast("int")), "MM/dd/yyyy")), cell(pick(k, ["Self", "Spouse", "?"])),
        cell(F.when(k % 2 == 0, F.concat(F.lit("<a href='x'>ab"), F.char(k + 65), F.lit("</a>"))).otherwise("--")), cell(F.col("n_name")), cell(F.lit("Stock")), cell(pick(k, _SENATE)),
        cell(F.when(k % 4 != 0, "$1,001 - $15,000").otherwise("$1,001 - $2,000")), cell(F.lit("")), F.lit("</tr></table>"),
    )
    return extract.html_trades(extract.html_tables(t.nation.select(k.alias("id"), F.concat(heads, row).alias("html")), "id", "html"))


def house_reports(t: Tables) -> DataFrame:
    """A row with a wrapped name and amount, one that is whole, one whose range is none; notes, and a footer with a row after it."""
    k = F.col("n_nationkey")
    first = F.concat(F.when(k % 2 == 0, "SP ").otherwise(""), F.lit("Acme "), F.col("n_name"), F.lit(" P 03/05/2024 03/06/2024 $1,001 -\nCommon Stock (AC"), F.char(k + 65), F.lit(") [ST] $15,000\nF S: New\nignored $5"))
    second = F.lit("Beta Fund [MF] S (partial) 3/7/2024 3/9/2024 Over $50,000,000\nD: a note\nmore of it")
    third = F.lit("Gamma (GM) [ZZ] E 3/8/2024 3/9/2024 $1,001 - $2,000")
    body = F.when(k % 5 == 4, "no table here").otherwise(F.concat_ws("\n", F.lit("Transactions"), first, second, third, F.lit("I CERTIFY that"), second))
    return t.nation.select(k.alias("id"), body.alias("text"))


@query("ext01_text_trades", """select n_nationkey as id, 1::bigint as nth, case when n_nationkey % 2 = 0 then 'spouse' else 'self' end as owner, 'AC' || chr(65 + n_nationkey::int) as ticker, 'Acme ' || n_name || ' Common Stock (AC' || chr(65 + n_nationkey::int) || ')' as asset, 'ST' as code, 'stock' as class, 'buy' as side, false as partial, date '2024-03-05' as date, '$1,001 - $15,000' as amount from nation where n_nationkey % 5 <> 4
union all select n_nationkey, 2, 'self', null, 'Beta Fund', 'MF', 'fund', 'sell', true, date '2024-03-07', 'Over $50,000,000' from nation where n_nationkey % 5 <> 4""")
def _(t: Tables) -> DataFrame:
    return extract.house_trades(house_reports(t))[0]


@query("ext01_report_status", "select n_nationkey as id, case when n_nationkey % 5 = 4 then 'needs_manual_review' else 'parsed' end as status, case when n_nationkey % 5 = 4 then 0 else 2 end::bigint as read, case when n_nationkey % 5 = 4 then 0 else 1 end::bigint as dropped from nation")
def _(t: Tables) -> DataFrame:
    return extract.house_trades(house_reports(t))[1]


@query("src13_embedded_array", "select n_nationkey as id, n_name as name, n_regionkey + 0.25::double as value from nation")
def _(t: Tables) -> DataFrame:
    page = F.concat(F.lit('<script>var xData = [{"name":"'), "n_name", F.lit('","value":'), (F.col("n_regionkey") + F.lit(0.25)).cast("string"), F.lit("},];</script>"))
    return t.nation.select(F.col("n_nationkey").alias("id"), F.inline(extract.embedded_array(page, "xData", "name string, value double")))


@query("src12_html_tables", "select n_nationkey as id, 0 as table, 0 as row, ['Name', 'Region'] as cells from nation union all select n_nationkey, 0, 1, [n_name, n_regionkey::varchar] from nation")
def _(t: Tables) -> DataFrame:
    page = F.concat(F.lit("<p>x</p><table><tr><th>Name</th><th>Region</th></tr><tr><td><b>"), "n_name", F.lit("</b></td><td> "), F.col("n_regionkey").cast("string"), F.lit("</td></tr></table>"))
    return extract.html_tables(t.nation.select(F.col("n_nationkey").alias("id"), page.alias("html")), "id", "html")


_STEM = "trim(regexp_replace(trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')), '( (inc|incorporated|corp|corporation|co|company|ltd|limited|plc|llc|lp|sa|nv|ag|the))+$', ''))"


@query("fin32_match_names", f"""with cat as (select {_STEM} as stem, ticker from (select s_name || ' Holdings Inc.' as n, 'S' || s_suppkey as ticker from supplier where s_suppkey % 3 <> 0)),
ix as (select stem, min(ticker) as ticker from cat group by 1 having count(distinct ticker) = 1),
nm as (select s_suppkey as id, {_STEM} as stem from (select s_suppkey, case when s_suppkey % 2 = 0 then s_name || ' Holdings' else s_name || ' Holdingz Corp' end as n from supplier)),
ex as (select id, ticker from nm join ix using (stem)), rs as (select * from nm where id not in (select id from ex)),
cd as (select rs.id, ix.ticker, 1 - levenshtein(rs.stem, ix.stem) / greatest(length(rs.stem), length(ix.stem))::double as s from rs join ix on split_part(rs.stem, ' ', 1) = split_part(ix.stem, ' ', 1)
  where abs(length(rs.stem) - length(ix.stem)) <= ceil((1 - 0.94) * greatest(length(rs.stem), length(ix.stem)))),
k as (select *, row_number() over w as k, lead(s) over w as runner from cd where s >= 0.94 window w as (partition by id order by s desc, ticker)), fz as (select id, ticker, s from k where k = 1 and (runner is null or s - runner >= 0.04))
select nm.id, coalesce(ex.ticker, fz.ticker) as ticker, case when ex.id is not null then 'exact' when fz.id is not null then 'fuzzy' end as stage, case when ex.id is not null then 100 else round(fz.s * 100)::bigint end as confidence
from nm left join ex using (id) left join fz using (id)""")
def _(t: Tables) -> DataFrame:
    s = spread(t.supplier.select("s_suppkey", "s_name"))
    cat = s.where("s_suppkey % 3 <> 0").select(F.concat("s_name", F.lit(" Holdings Inc.")).alias("name"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.lit("NYSE").alias("exchange"))
    nm = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" Holdings"))).otherwise(F.concat("s_name", F.lit(" Holdingz Corp"))).alias("name"))
    found = names.match_names(nm, cat)
    return found.select("id", "ticker", F.nullif("stage", F.lit("none")).alias("stage"), F.col("confidence").cast("long").alias("confidence"))


def _stored(t: Tables) -> DataFrame:
    return t.daily_points.where("date < '2024-01-20'")


def _incoming(t: Tables) -> DataFrame:
    return t.daily_points.where("date >= '2024-01-15'").select("symbol", "date", F.when(F.dayofmonth("date") % 2 == 0, F.col("close") + 1).otherwise(F.col("close")).alias("close"), F.lit(1).cast("long").alias("ord"))


_IN = "inc as (select symbol, date, case when day(date) % 2 = 0 then close + 1 else close end as close from daily_points where date >= date '2024-01-15'), st as (select * from daily_points where date < date '2024-01-20')"


@query("snk01_upsert", f"with {_IN} select * from inc union all select * from st where (symbol, date) not in (select (symbol, date) from inc)", "daily_points")
def _(t: Tables) -> DataFrame:
    return writes.upsert(_stored(t), _incoming(t), ["symbol", "date"])


@query("snk01_changed_rows", f"with {_IN} select inc.* from inc left join st using (symbol, date) where st.close is distinct from inc.close", "daily_points")
def _(t: Tables) -> DataFrame:
    return writes.changed(_stored(t), _incoming(t), ["symbol", "date"], "close").drop("ord")


@query("snk02_only_missing", f"with {_IN} select inc.* from inc where (symbol, date) not in (select (symbol, date) from st)", "daily_points")
def _(t: Tables) -> DataFrame:
    return writes.only_missing(_stored(t), _incoming(t), ["symbol", "date"]).drop("ord")


@query("snk04_overlap_plan", f"""with {_IN} select symbol, count(*) filter (st.close is null) as added, count(*) filter (st.close <> inc.close) as overwritten, count(*) filter (st.close = inc.close) as unchanged,
count(*) filter (inc.close is null) as kept, min(date) as first, max(date) as last from st full join inc using (symbol, date) group by symbol""", "daily_points")
def _(t: Tables) -> DataFrame:
    return writes.overlap_plan(_stored(t), _incoming(t).drop("ord"), ["symbol"], "date", "close")


@query("snk12_continue_numbers", "select o_custkey, o_orderkey, (select count(*) from orders p where p.o_custkey = o.o_custkey and p.o_orderkey <= 5000) + row_number() over (partition by o_custkey order by o_orderkey) as row_index from orders o where o_orderkey > 5000")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    stored = t.orders.where("o_orderkey <= 5000").select("o_custkey", F.row_number().over(w).alias("row_index"))
    return writes.continue_numbers(stored, t.orders.where("o_orderkey > 5000").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("snk06_batch_status", """select o_orderkey as ord, case when o_custkey % 4 = 0 then 'unknown' when o_custkey % 4 = 1 or o_orderstatus = 'P' then 'skipped' when o_orderkey % 5 = 0 then 'bad_date' when o_orderkey % 7 = 0 then 'bad_value'
  when o_orderkey < max(o_orderkey) over (partition by o_custkey, case when o_orderkey % 5 = 0 then 'x' else '2024-01-0' || (o_orderkey % 3 + 1) end) then 'superseded' else 'accepted' end as status from orders""")
def _(t: Tables) -> DataFrame:
    o, m = t.orders, F.col("c_custkey") % 4
    inst = t.customer.where(m != 0).select(F.col("c_custkey").alias("id"), F.when(m == 1, "cash").otherwise("stock").alias("type"))
    date = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.concat(F.lit("2024-01-0"), F.col("o_orderkey") % 3 + 1))
    value = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(1.0))
    return writes.batch_status(o.select(F.col("o_custkey").alias("id"), date.alias("date"), value.alias("value"), F.col("o_orderkey").alias("ord")), inst).select("ord", "status")
