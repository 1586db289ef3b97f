"""Queries on funds' documents: three kinds for the customers, with figures from their keys; the SQL states the facts in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fundsheets
from ..sources.kept import spread
from ..sources.tables import Tables
from .registry import query

_K = "c_custkey"


def sheets(t: Tables) -> DataFrame:
    """Facts for all, without lists for every third; a pulse page for every second, a monthly one for every fifth of the others."""
    k = F.col(_K)
    s = lambda x: x.cast("string")
    a, b = s(k % 50 + F.lit(20.5)), s(k % 9 + F.lit(1.25))
    lists = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("BY COUNTRY\nCanada 61.5%\nUnited States 30%\nBY SECTOR\nEnergy "), a, F.lit("%\nFinancials 12.04%\nEnergy 3%\nTotal 100%\nHOW RISKY\n")))
    facts = F.concat(F.lit("Series F APRIL 24, 2026\nManagement expense ratio (MER) "), b, F.lit("%\nInvestment mix as at March 31, 2026\n"), lists, F.lit("The return for 2023 was "), s(-(k % 7)), F.lit("% and the return for 2022 was 4.5%. Ten years ago you had an annual compound return of 6.1%."))
    pulse = F.concat(F.lit("Sector Mix (%)\nTechnology "), a, F.lit(" %\nCountry Mix (%)\nJapan 10 %\nSource: x\nPerformance (Class F) as at June 30, 2026\nStandard Period Returns\n1 Mo "), b, F.lit("\n3 Year 5.5\nSince Inception -2\nCalendar Year Returns\nYTD 2025 2024\n1.5\n"), s(k % 7), F.lit("\n-3.25\n\nNAV - Class F $"), s(k % 30 + F.lit(10.5)), F.lit(" (as at June 30, 2026)"))
    monthly = F.concat(F.lit("Performance analysis for Series F as of May 31, 2026\n1 Mth 3 Mth 6 Mth 1 Yr 3 Yr Since incep.\nTrailing return % "), b, F.lit(" 2 3 -4.5 5 6\nCalendar returns % 2024 2025 YTD\n7.5 "), s(k % 7), F.lit(" 1.25 Fund\nPortfolio analysis as of May 31, 2026\nAsset mix\nCanada 55.5%\nOil 4%\nEquity style\nEquity sector allocation\nUtilities "), a, F.lit("%\nDisclosure\nSeries F NAV $ "), s(k % 30 + F.lit(10.5)), F.lit("\nSeries F MER % 2.5"))
    made = F.array(facts, F.when(k % 2 == 0, pulse).when(k % 5 == 1, monthly))
    return spread(t.customer.select(_K)).select(k.alias("id"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("text"))


_FACTS = """c as (select c_custkey as id, c_custkey % 50 + 20.5::double as a, c_custkey % 9 + 1.25::double as b, c_custkey % 7 as y, c_custkey % 30 + 10.5::double as nav, c_custkey % 3 <> 0 as lists, case when c_custkey % 2 = 0 then 'pulse' when c_custkey % 5 = 1 then 'monthly' end as other from customer),
f as (select id, 'facts' as kind, case when lists then [{'label': 'Energy', 'weight': a}, {'label': 'Financials', 'weight': 12.0}] else [] end as sectors, case when lists then [{'label': 'Canada', 'weight': 61.5::double}, {'label': 'United States', 'weight': 30.0::double}] else [] end as countries, date '2026-03-31' as as_of, b as mer,
  [{'period': 'y10ann', 'value': 0.061::double}] as periods, [{'year': 2023, 'ytd': false, 'value': -y / 100.0::double}, {'year': 2022, 'ytd': false, 'value': 0.045::double}] as years, null::double as nav, null::date as nav_date from c),
o as (select id, other as kind, case other when 'pulse' then [{'label': 'Technology', 'weight': a}] else [{'label': 'Utilities', 'weight': a}] end as sectors, case other when 'pulse' then [{'label': 'Japan', 'weight': 10.0::double}] else [{'label': 'Canada', 'weight': 55.5::double}] end as countries, case other when 'pulse' then date '2026-06-30' else date '2026-05-31' end as as_of, case other when 'monthly' then 2.5 end::double as mer,
  case other when 'pulse' then [{'period': 'm1', 'value': b / 100}, {'period': 'y3ann', 'value': 0.055}, {'period': 'inceptionAnn', 'value': -0.02}] else [{'period': 'm1', 'value': b / 100}, {'period': 'm3', 'value': 0.02}, {'period': 'm6', 'value': 0.03}, {'period': 'y1', 'value': -0.045}, {'period': 'y3ann', 'value': 0.05}, {'period': 'inceptionAnn', 'value': 0.06}] end as periods,
  case other when 'pulse' then [{'year': 2026, 'ytd': true, 'value': 0.015}, {'year': 2025, 'ytd': false, 'value': y / 100.0::double}, {'year': 2024, 'ytd': false, 'value': -0.0325}] else [{'year': 2024, 'ytd': false, 'value': 0.075}, {'year': 2025, 'ytd': false, 'value': y / 100.0::double}, {'year': 2026, 'ytd': true, 'value': 0.0125}] end as years, nav, case other when 'pulse' then date '2026-06-30' else date '2026-05-31' end as nav_date from c where other is not null)"""


@query("ext10_fund_sheets", f"with {_FACTS} select * from f union all select * from o")
def _(t: Tables) -> DataFrame:
    return fundsheets.fund_sheets(sheets(t))


@query("ext11_merged_sheets", f"""with {_FACTS} select f.id, case when o.kind = 'monthly' or (o.kind = 'pulse' and len(f.sectors) = 0) then o.sectors else f.sectors end as sectors, case when o.kind = 'monthly' or (o.kind = 'pulse' and len(f.sectors) = 0) then o.countries else f.countries end as countries,
case when o.kind = 'monthly' or (o.kind = 'pulse' and len(f.sectors) = 0) then o.as_of else f.as_of end as as_of, case when o.kind = 'monthly' then 'monthly' when o.kind = 'pulse' and len(f.sectors) = 0 then 'pulse' else 'facts' end as document, f.mer,
list_sort(list_concat(coalesce(o.periods, []), f.periods)) as periods, list_sort(list_concat(coalesce(o.years, []), f.years)) as years, o.nav, o.nav_date from f left join o using (id)""")
def _(t: Tables) -> DataFrame:
    return fundsheets.merged_sheets(fundsheets.fund_sheets(sheets(t)))
