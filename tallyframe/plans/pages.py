"""Queries on word boxes of pages. The pages are laid out from the tables' rows; the SQL states what stands on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import index_rows
from ..operators import boxes, extract
from ..operators.ranks import numbered
from ..sources import files
from ..sources.kept import shared_folder, spread
from ..sources.tables import Tables
from .registry import query


def laid_out(docs: DataFrame, items: list[tuple[Column | None, int, float, float, Column | str]]) -> DataFrame:
    """(doc, page, x, y, text): a box for each item whose condition holds."""
    box = lambda page, x, y, text: F.struct(F.lit(page).alias("page"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    made = F.array(*[box(*rest) if when is None else F.when(when, box(*rest)) for when, *rest in items])
    return docs.select("doc", F.explode(F.filter(made, lambda b: b.isNotNull())).alias("b")).select("doc", "b.*")


@query("win22_text_lines", """with w as (select l_orderkey as doc, dense_rank() over (partition by l_orderkey order by l_linenumber) - 1 as line, l_partkey as x, l_partkey::varchar as w from lineitem)
select doc, 1 as page, line::int as line, string_agg(w, ' ' order by x, w) as text from w group by doc, line""")
def _(t: Tables) -> DataFrame:
    """Lines 12 apart, of words 10 high that slope by up to 7 within a line, so single gaps reach over what parts two lines."""
    li = t.lineitem.withColumn("nth", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    y = F.col("nth") * 20.0 + F.col("l_partkey") % 8
    words = li.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_partkey").cast("string").alias("text"), F.lit(90).alias("confidence"), F.col("l_partkey").alias("x"), y.alias("y"), F.col("l_partkey").alias("x1"), (y + 10).alias("y1"))
    return boxes.scan_lines(words).select("doc", "page", "line", "text")


#: A scan a part: a good trade, and by the part's key one whose word for the side, date, sum, confidence or name is not good enough.
def scans(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    docs = spread(t.part.select("p_partkey", "p_name")).select(k.alias("doc"), "p_partkey", "p_name")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % 6 + 1).cast("int"))
    items = [
        (None, 1, 5, 10, "#"), (None, 1, 40, 10, "Description"),
        (None, 1, 5, 31, "1"), (None, 1, 40, 30, F.col("p_name")), (None, 1, 90, 34, F.concat(F.lit("(AC"), F.char(k % 26 + 65), F.lit(")"))), (None, 1, 300, 33, "purchaso"), (None, 1, 400, 32, "3/9/2024"), (None, 1, 500, 35, "$1,001"), (None, 1, 540, 31, "-"), (None, 1, 560, 36, "$15,000"),
        (None, 1, 5, 61, "2"), (None, 1, 40, 60, "spouse:"), (None, 1, 60, 60, "Gold"), (None, 1, 80, 62, "bond"), (None, 1, 300, 63, pick("Sale", "gift", "Sale", "Sale", "Sale", "Sale")), (None, 1, 400, 62, pick("3/10/2024", "3/10/2024", "3/10/2011", "3/10/2024", "3/10/2024", "13/40/2024")),
        (None, 1, 500, 65, "$15,001"), (None, 1, 560, 61, pick("$50,000", "$50,000", "$50,000", "$49,000", "$50,000", "$50,000")),
    ]
    x = laid_out(docs, items)
    weak = (F.col("doc") % 6 == 4) & (F.col("text") == "3/10/2024")
    return x.select("doc", "page", "text", F.when(weak, 59).otherwise(60 + F.col("doc") % 40).alias("confidence"), "x", "y", (F.col("x") + 9).alias("x1"), (F.col("y") + 10).alias("y1"))


@query("ext04_scanned_trades", """select p_partkey as doc, 1 as page, 1 as line, 'unknown' as owner, 'AC' || chr(65 + (p_partkey % 26)::int) as ticker, p_name || ' (AC' || chr(65 + (p_partkey % 26)::int) || ')' as asset, 'buy' as side, date '2024-03-09' as date, '$1,001 - $15,000' as amount, (60 + p_partkey % 40)::int as confidence from part
union all select p_partkey, 1, 2, 'spouse', null, 'Gold bond', 'sell', date '2024-03-10', '$15,001 - $50,000', (60 + p_partkey % 40)::int from part where p_partkey % 6 = 0""")
def _(t: Tables) -> DataFrame:
    return boxes.scanned_trades(scans(t), 2025)[0].drop("class")


@query("ext04_scan_counts", "select p_partkey as doc, 1 as page, case when p_partkey % 6 = 0 then 0 else 1 end::bigint as rejected, true as saw_table from part")
def _(t: Tables) -> DataFrame:
    return boxes.scanned_trades(scans(t), 2025)[1]


#: A report a customer: with holdings over two pages, whose headers stand apart; with nothing to disclose; a scan; with values
#: that are no ranges; without the schedule.
def reports(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    docs = spread(t.customer.select("c_custkey", "c_name")).select(F.col("c_custkey").alias("doc"), "c_custkey", "c_name")
    whole, none, odd = k == 0, k == 1, k == 3
    table = whole | odd
    head = lambda page, y, a, o, v, i: [(table, page, a, y, "Asset"), (table, page, o, y + 1, "Owner"), (table, page, v, y, "Value of Asset"), (table, page, i, y + 2, "Income Type(s)")]
    items = [
        (k != 2, 1, 10, 2, "Filing ID #10001"), (k == 2, 1, 10, 2, "scan"), (k == 4, 1, 10, 30, F.lit("Words of a letter that has no schedule of assets at all " * 3)),
        (table | none, 1, 10, 10, "S A:"), (table | none, 1, 60, 11, "Assets and Income"), (none, 1, 10, 20, "None disclosed."),
        *head(1, 20, 10, 200, 260, 380),
        (whole, 1, 10, 30, F.concat(F.lit("Acme "), F.col("c_name"))), (whole, 1, 120, 31, "(AC.B) [ST]"), (whole, 1, 200, 30, "SP"), (whole, 1, 260, 32, "$1,001 -"), (whole, 1, 380, 30, "Dividends"),
        (whole, 1, 10, 42, "Class B Shares"), (whole, 1, 260, 42, "$15,000"), (whole, 1, 10, 54, "D: left by a note"),
        (whole, 1, 10, 64, "Beta Fund [MF]"), (whole, 1, 260, 64, "Over $50,000,000"), (whole, 1, 10, 76, "of the second line"),
        (odd, 1, 10, 30, "Zeta [PS] DC"), (odd, 1, 260, 30, "$2 - $3"), (odd, 1, 10, 40, "Eta [BA]"), (odd, 1, 260, 40, "None"),
        *head(2, 5, 40, 300, 360, 480),
        (whole, 2, 40, 20, "Gamma LLC [OL]"), (whole, 2, 300, 20, "JT"), (whole, 2, 360, 21, "Undetermined"), (whole, 2, 40, 30, "Delta Bank [BA]"), (whole, 2, 360, 30, "None"),
        (odd & (F.col("c_custkey") % 2 == 0), 2, 40, 20, "Theta [QQ] JT"), (odd & (F.col("c_custkey") % 2 == 0), 2, 360, 21, "$15,001 - $50,000"),
        (table, 2, 40, 60, "S B: Transactions"), (table, 2, 40, 70, "Epsilon [ST]"), (table, 2, 360, 70, "$1,001 - $15,000"),
    ]
    return laid_out(docs, items)


@query("ext05_schedule_holdings", """select c_custkey as doc, 1 as nth, 'Acme ' || c_name || ' (AC.B) Class B Shares' as asset, 'AC.B' as ticker, 'stock' as class, 'ST' as code, 'spouse' as owner, 'range' as bound, 1001::bigint as low, 15000::bigint as high, 8001::bigint as mid, '$1,001 - $15,000' as label from customer where c_custkey % 5 = 0
union all select c_custkey, 2, 'Beta Fund of the second line', null, 'etf_fund', 'MF', 'self', 'at_least', 50000000, null, 50000000, 'Over $50,000,000' from customer where c_custkey % 5 = 0
union all select c_custkey, 3, 'Gamma LLC', null, 'private', 'OL', 'joint', 'undetermined', null, null, null, 'Undetermined' from customer where c_custkey % 5 = 0
union all select c_custkey, 3, 'Theta', null, 'other', 'QQ', 'joint', 'range', 15001, 50000, 32501, '$15,001 - $50,000' from customer where c_custkey % 5 = 3 and c_custkey % 2 = 0""")
def _(t: Tables) -> DataFrame:
    return boxes.schedule_holdings(reports(t))[0]


@query("ext05_report_status", """select c_custkey as doc, case c_custkey % 5 when 0 then 'parsed' when 1 then 'parsed' when 2 then 'pending_ocr' when 3 then 'partial' else 'needs_manual_review' end as status, c_custkey % 5 = 1 as none_disclosed,
case when c_custkey % 5 = 0 then 3 when c_custkey % 5 = 3 and c_custkey % 2 = 0 then 1 else 0 end::bigint as holdings, case when c_custkey % 5 in (0, 3) then 1 else 0 end::bigint as excluded, case when c_custkey % 5 = 3 then 1 else 0 end::bigint as unreadable from customer""")
def _(t: Tables) -> DataFrame:
    return boxes.schedule_holdings(reports(t))[1]


#: An executive report a supplier: the filer's assets, the spouse's on the same page, and on the next those without an owner.
def executive_reports(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    docs = spread(t.supplier.select("s_suppkey", "s_name")).select(F.col("s_suppkey").alias("doc"), "s_suppkey", "s_name")
    whole, odd = k == 0, k == 1
    head = lambda page, y, shift: [(None if page == 1 else whole, page, 20 + shift, y, "#"), (None if page == 1 else whole, page, 40 + shift, y, "Description"), (None if page == 1 else whole, page, 300 + shift, y, "EIF"), (None if page == 1 else whole, page, 340 + shift, y, "Value"), (None if page == 1 else whole, page, 500 + shift, y, "Income Type")]
    items = [
        (None, 1, 10, 2, "Report Year (Annual Report): 2024"), (k != 2, 1, 10, 10, "Part 2: Filer's Employment Assets"), *head(1, 20, 0),
        (whole, 1, 40, 30, F.concat(F.lit("Alpha "), F.col("s_name"))), (whole, 1, 300, 30, "No"), (whole, 1, 340, 30, "$1,001 -"), (whole, 1, 500, 30, "Rent"), (whole, 1, 340, 40, "$15,000"), (whole, 1, 40, 50, "(ALF) common stock *"),
        (odd, 1, 40, 30, "Beta"), (odd, 1, 340, 30, "$2 - $3"), (odd, 1, 40, 40, "Zeta Bank"), (odd, 1, 340, 40, "None (or less than $1,001)"), (odd, 1, 40, 46, "12"), (odd, 1, 340, 46, "$1,001 - $15,000"),
        (k == 2, 1, 40, 30, F.lit("words of a cover letter without any part at all " * 3)),
        (whole, 1, 10, 60, "Part 5: Spouse's Assets"), (whole, 1, 40, 70, "Gamma Fund"), (whole, 1, 340, 70, "Over $50,000,000"), (whole, 1, 40, 80, "Note:"),
        (whole, 2, 60, 5, "of three lines"), (whole, 2, 10, 10, "Part 6: Other Assets"), *head(2, 20, 30), (whole, 2, 70, 30, "Delta bond"), (whole, 2, 370, 30, "$15,001 - $50,000"),
    ]
    return laid_out(docs, items)


@query("ext08_part_holdings", """select s_suppkey as doc, 1 as nth, 'Alpha ' || s_name || ' (ALF) common stock' as asset, 'ALF' as ticker, 'self' as owner, 'range' as bound, 1001::bigint as low, 15000::bigint as high, 8001::bigint as mid, '$1,001 - $15,000' as label from supplier where s_suppkey % 3 = 0
union all select s_suppkey, 2, 'Gamma Fund', null, 'spouse', 'at_least', 50000000, null, 50000000, 'Over $50,000,000' from supplier where s_suppkey % 3 = 0 union all select s_suppkey, 3, 'Delta bond', null, 'unknown', 'range', 15001, 50000, 32501, '$15,001 - $50,000' from supplier where s_suppkey % 3 = 0""")
def _(t: Tables) -> DataFrame:
    return boxes.part_holdings(executive_reports(t))[0].drop("class")


@query("ext08_part_status", """select s_suppkey as doc, case s_suppkey % 3 when 0 then 'parsed' when 1 then 'partial' else 'needs_manual_review' end as status, 2024 as report_year, case when s_suppkey % 3 = 0 then 3 else 0 end::bigint as holdings, (s_suppkey % 3 = 1)::bigint as excluded, case when s_suppkey % 3 = 1 then 2 else 0 end::bigint as unreadable from supplier""")
def _(t: Tables) -> DataFrame:
    return boxes.part_holdings(executive_reports(t))[1]


def asset_pages(t: Tables) -> DataFrame:
    """A report a part: in one of three with its ticker linked; with values of none and of no range; in one of four without the table."""
    k = F.col("p_partkey")
    cell = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))
    link = F.when(k % 3 == 0, F.concat(F.lit("<a href='https://x.y/q?s=ac"), F.char(k % 26 + 97), F.lit("&amp;t=1'>AC</a> <strong>AC"), F.char(k % 26 + 65), F.lit(" - "), F.col("p_name"), F.lit("</strong><div>more of it</div>"))).otherwise(F.col("p_name"))
    value = F.element_at(F.array(*map(F.lit, ("$1,001 - $15,000", "None (or less than $1,001)", "$7 - $8", "Over $50,000,000"))), (k % 4 + 1).cast("int"))
    who = F.element_at(F.array(*map(F.lit, ("Self", "Child", "Joint", ""))), (k % 4 + 1).cast("int"))
    row = F.concat(F.lit("<tr>"), cell(F.lit("1")), cell(link), cell(F.lit("Corporate Securities<div>Stock</div>")), cell(who), cell(value), F.lit("</tr>"))
    heads = F.when(k % 5 == 4, "<tr><th>Asset</th><th>Owner</th></tr>").otherwise("<tr><th></th><th>Asset</th><th>Asset Type</th><th>Owner</th><th>Value</th></tr>")
    return spread(t.part.select("p_partkey", "p_name")).select(k.alias("id"), F.concat(F.lit("<table><tr><th>Other</th></tr><tr><td>x</td></tr></table><table>"), heads, row, F.lit("</table>")).alias("html"))


@query("ext07_annual_holdings", """select p_partkey as id, 1 as row, p_name as asset, case when p_partkey % 3 = 0 then 'AC' || chr(65 + (p_partkey % 26)::int) end as ticker, 'Corporate Securities' as kind, 'Stock' as subkind, case p_partkey % 4 when 0 then 'self' when 3 then 'self' end as owner,
case p_partkey % 4 when 0 then 'range' else 'at_least' end as bound, case p_partkey % 4 when 0 then 1001 else 50000000 end::bigint as low, case p_partkey % 4 when 0 then 15000 end::bigint as high, case p_partkey % 4 when 0 then 8001 else 50000000 end::bigint as mid, case p_partkey % 4 when 0 then '$1,001 - $15,000' else 'Over $50,000,000' end as label from part where p_partkey % 4 in (0, 3) and p_partkey % 5 <> 4""")
def _(t: Tables) -> DataFrame:
    return extract.annual_html_holdings(extract.html_cells(asset_pages(t), "id", "html"))[0]


@query("ext07_annual_status", """select p_partkey as id, case when p_partkey % 5 = 4 or p_partkey % 4 = 2 then 'needs_manual_review' else 'parsed' end as status, (p_partkey % 5 <> 4 and p_partkey % 4 in (0, 3))::bigint as holdings, (p_partkey % 5 <> 4 and p_partkey % 4 = 1)::bigint as excluded, (p_partkey % 5 <> 4 and p_partkey % 4 = 2)::bigint as unreadable from part""")
def _(t: Tables) -> DataFrame:
    return extract.annual_html_holdings(extract.html_cells(asset_pages(t), "id", "html"))[1]


#: Index records of a quarter of all orders each: posted, to be requested, of another kind, undated.
def answered(orders: DataFrame) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("day", "yyyy-MM-dd")
    kind = F.when(k % 4 == 0, F.concat(F.lit("<a href='https://a.b/0123456789ABCDE"), F.hex(k % 16), F.lit("/$FILE/x.pdf'>278 Transaction</a>"))).when(k % 4 == 1, "<b>278 Transaction</b> Request this Document").when(k % 4 == 2, "278 Annual").otherwise("278  Transaction")
    title = F.when(k % 3 == 0, "President ").when(k % 3 == 1, "Vice President").otherwise("Secretary")
    return orders.select("*", F.when(k % 4 == 3, "").otherwise(F.concat(day, F.lit("T00:00:00"))).alias("docDate"), title.alias("title"), kind.alias("type"), F.concat(F.lit("Doe, Ann "), k.cast("string")).alias("name"))


def written_pages(t: Tables) -> str:
    """Pages of 100, newest first, a line each; the third page is swapped with the last."""
    orders = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    x = numbered(orders, [F.desc("day"), F.asc("o_orderkey")], "n", total="_all")
    first = lambda n: (F.floor((n - 1) / 100) * 100).cast("int")
    start, last = first(F.col("n")), first(F.col("_all"))
    x = answered(x).withColumn("start", F.when(start == 200, last).when(start == last, 200).otherwise(start))
    path = shared_folder(t.spark, "pages")
    body = x.groupBy("start").agg(F.count("*").alias("recordsFiltered"), F.collect_list(F.struct("docDate", "title", "type", "name")).alias("data"))
    body.write.json(path)
    return path


@query("src19_paged_rows", """select case when o_orderkey % 4 = 0 then '0123456789ABCDE' || upper(to_hex(o_orderkey % 16)) else 'request:doe, ann ' || o_orderkey || ':' || case when o_orderkey % 4 = 3 then 'undated' else o_orderdate::date::varchar end end as filing_key, 'Ann ' || o_orderkey as first, 'Doe' as last,
case when o_orderkey % 3 = 0 then 'president' when o_orderkey % 3 = 1 then 'vice-president' end as office, case when o_orderkey % 4 <> 3 then o_orderdate::date end as filed_date, o_orderkey % 4 <> 0 as request from orders where o_orderkey % 4 <> 2""")
def _(t: Tables) -> DataFrame:
    rows = files.paged_json(t.spark, written_pages(t))
    return rows.select(index_rows.executive_row(F.col("type"), F.col("title"), F.col("name"), F.col("docDate")).alias("r")).where("r is not null").select("r.filing_key", "r.first", "r.last", "r.office", "r.filed_date", "r.request")


@query("src19_page_order", """with x as (select o_orderdate::date as day, o_orderkey, (row_number() over (order by o_orderdate::date desc, o_orderkey) - 1) // 100 * 100 as start from orders), m as (select max(start) as last from x),
s as (select case when start = 200 then last when start = last then 200 else start end as start, min(day) filter (o_orderkey % 4 <> 3) as old, max(day) filter (o_orderkey % 4 <> 3) as new from x, m group by 1),
n as (select start, old >= lag(new) over (order by start) as up, new <= lag(old) over (order by start) as down from s) select 'descending' as direction, list(start::int order by start) filter (not down) as unordered from n""")
def _(t: Tables) -> DataFrame:
    return files.page_order(files.paged_json(t.spark, written_pages(t)))


@query("rec18_senate_rows", """with r as (select o_orderkey as k, o_orderdate::date as filed_date, lower('0000000' || to_hex(o_orderkey % 16) || '-aaaa-bbbb-cccc-' || lpad(o_orderkey::varchar, 12, '0')) as filing_key from orders where o_orderkey % 5 <> 4)
select k, filing_key, case k % 3 when 0 then 'ptr' when 1 then 'paper' else 'annual' end as kind, filed_date, case when k % 3 = 2 then 2023 end as report_year, case when k % 3 = 2 then 'amendment' end as filing_kind,
case when k % 3 = 1 then '' else 'https://efdsearch.senate.gov' end as host from r""")
def _(t: Tables) -> DataFrame:
    """Periodic reports, scans with whole addresses, and annual ones, which only the annual reading takes; rows of four cells are none."""
    k = F.col("o_orderkey")
    uuid = F.concat(F.lit("0000000"), F.hex(k % 16), F.lit("-aaaa-bbbb-cccc-"), F.lpad(k.cast("string"), 12, "0"))
    path = F.concat(F.when(k % 3 == 0, "/search/view/ptr/").when(k % 3 == 1, "https://x.y/search/view/paper/").otherwise("/search/view/annual/"), uuid, F.lit("/"))
    label = F.when(k % 3 == 2, "Annual Report for CY 2023 (Amendment 1)").otherwise("Periodic Transaction Report")
    cells = F.array(F.lit(" Ann "), F.lit("Doe"), F.lit("Senator"), F.concat(F.lit('<a href="'), path, F.lit('">'), label, F.lit("</a>")), F.date_format(F.to_date("o_orderdate"), "MM/dd/yyyy"))
    cells = F.when(k % 5 == 4, F.slice(cells, 1, 4)).otherwise(cells)
    orders = spread(t.orders.select("o_orderkey", "o_orderdate"))
    rows = lambda annual: orders.select(k.alias("k"), F.inline(F.array_compact(F.array(index_rows.senate_row(cells, annual)))))
    host = F.when(F.col("url").startswith(index_rows.SENATE), index_rows.SENATE).otherwise("")
    return rows(False).unionByName(rows(True)).select("k", "filing_key", "kind", "filed_date", "report_year", "filing_kind", host.alias("host"))
