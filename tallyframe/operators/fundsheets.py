"""Funds' own documents to facts: what they hold, what they cost, and the returns that they publish; and two documents of a fund merged.

Three kinds are read: facts (the yearly document), pulse (a quarterly page with a performance table) and monthly (a page whose
periods stand in a row above their values). All by built-in expressions; nothing is derived from a figure that is not printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import between_marks, is_no_label
from ..functions.text import loose_date, once
from .extract import labelled_percents

# Periods as they are written, and their keys.
PERIODS = {
    "m1": ("1 mo", "1 month", "1 mth"), "m3": ("3 mo", "3 month", "3 mth"), "m6": ("6 mo", "6 month", "6 mth"), "y1": ("1 yr", "1 year"), "y2ann": ("2 yr", "2 year"), "y3ann": ("3 yr", "3 year"), "y5ann": ("5 yr", "5 year"),
    "y10ann": ("10 yr", "10 year"), "y15ann": ("15 yr", "15 year"), "y20ann": ("20 yr", "20 year"), "inceptionAnn": ("since inception", "since incep", "inception"),
}
# Where each kind's lists begin and end.
SECTIONS = {
    "facts": (("by sector", "how risky|how has the fund performed"), ("by country", "by sector|how risky")),
    "pulse": ((r"sector mix\s*\(%\)", "country mix|fund strategy|fund facts|©"), (r"country mix\s*\(%\)", "source:|fund strategy|fund facts|©")),
    "monthly": (("equity sector allocation", r"highest/lowest|disclosure|portfolio manager|these pages are not complete"), ("asset mix", r"value\s+blend|equity style|equity characteristics|dividend yield")),
}
GEOGRAPHY = ("Canada", "United States", "International", "Emerging Markets", "Global")
DAY = r"[A-Za-z]+\s+\d{1,2},?\s+20\d\d"
_NUMBER = r"-?\d+(?:\.\d+)?"


def kind_of(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("performance analysis for series"), "monthly").when(t.contains("standard period returns"), "pulse").otherwise("facts")


def _day(raw: Column) -> Column:
    return loose_date(F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"^(\w+) (\d+),? ", "$1 $2, "))


def day_after(text: Column, heading: str) -> Column:
    """The first date after a heading's first match, in 220 letters; null without either."""
    window = F.regexp_extract(text, rf"(?is)(?:{heading})(.{{0,220}})", 1)
    told = F.nullif(F.regexp_extract(window, rf"(?i)as at\s+({DAY})", 1), F.lit(""))
    return _day(F.coalesce(told, F.regexp_extract(window, rf"({DAY})", 1)))


def weights(section: Column) -> Column:
    """(label, weight) of a section's labelled percents: positive ones, the first of each label, with one decimal, the largest first."""
    rows = once(F.coalesce(section, F.lit("")), lambda s: F.filter(labelled_percents(s), lambda r: (r["percent"] > 0) & ~is_no_label(r["label"])))
    first = once(rows, lambda xs: F.filter(xs, lambda r, i: F.array_position(F.transform(xs, lambda x: x["label"]), r["label"]) == i + 1))
    ranked = F.array_sort(F.transform(first, lambda r, i: F.struct((-r["percent"]).alias("k"), i.alias("i"), r["label"].alias("label"), F.round(r["percent"], 1).alias("weight"))))
    return F.transform(ranked, lambda r: F.struct(r["label"].alias("label"), r["weight"].alias("weight")))


def _period(label: Column) -> Column:
    keys = F.create_map(*(F.lit(x) for key, names in PERIODS.items() for n in names for x in (n, key)))
    return F.try_element_at(keys, F.regexp_replace(F.lower(F.trim(label)), r"\s+|\.$", " ").substr(1, 40))


def _zipped(names: Column, values: Column) -> Column:
    """(period, value) by position, without those that have no period; percents become shares."""
    rows = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda r: F.struct(r["n"].alias("period"), (r["v"].try_cast("double") / 100).alias("value")))
    return F.filter(rows, lambda r: r["period"].isNotNull() & r["value"].isNotNull())


def periods(text: Column, kind: Column) -> Column:
    """(period, value) of the published returns over periods: lines of a label and a number, or a row of labels above one of numbers."""
    block = F.coalesce(between_marks(text, "standard period returns", "growth of|calendar year|risk classification|quarterly top"), F.lit(""))
    line = rf"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9 ]{{0,23}}?)[ \t]+({_NUMBER})[ \t]*%?[ \t]*$"
    listed = _zipped(F.transform(F.regexp_extract_all(block, F.lit(line), F.lit(1)), lambda n: _period(n)), F.regexp_extract_all(block, F.lit(line), F.lit(2)))
    head = r"(?i)\d+\s*(?:mth|yr)s?|since incep(?:tion)?"
    table = F.regexp_extract(text, rf"(?is)((?:(?:\d+\s*(?:mth|yr)s?|since incep(?:tion)?\.?)\s+){{3,}})trailing return\s*%?\s+((?:{_NUMBER}\s*)+)", 0)
    names = F.transform(F.regexp_extract_all(F.regexp_extract(table, r"(?is)^(.*?)trailing return", 1), F.lit(f"({head})"), F.lit(1)), lambda n: _period(F.regexp_replace(n, r"(?i)(\d)\s*(mth|yr)s?", "$1 $2")))
    rowed = _zipped(names, F.regexp_extract_all(F.regexp_extract(table, r"(?is)trailing return\s*%?\s+(.*)$", 1), F.lit(f"({_NUMBER})"), F.lit(1)))
    compound = rf"(?i)annual compound return of +({_NUMBER}) ?%"
    decade = F.regexp_extract(F.regexp_extract(text, "(?is)ten years ago(.{0,300})", 1), compound, 1)
    whole = F.regexp_extract(text, compound, 1)
    told = _zipped(F.array(F.when(decade != "", "y10ann").otherwise("inceptionAnn")), F.array(F.when(decade != "", decade).otherwise(whole)))
    return F.when(kind == "pulse", listed).when(kind == "monthly", rowed).otherwise(told)


def calendar(text: Column, kind: Column, as_of: Column) -> Column:
    """(year, ytd, value) of calendar years: a row of years zipped with the numbers that follow, or sentences. The year to date is that of as_of."""
    numbers = lambda s: F.regexp_extract_all(s, F.lit(f"({_NUMBER})"), F.lit(1))
    years = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"(20\d\d)"), F.lit(1)), lambda y: y.cast("int"))
    row = lambda y, now, v: F.struct(y.cast("int").alias("year"), now.alias("ytd"), (v.try_cast("double") / 100).alias("value"))
    no, yes = F.lit(False), F.lit(True)
    zipped = lambda ys, vs: F.transform(F.arrays_zip(ys.alias("y"), vs.alias("v")), lambda r: row(r["y"], no, r["v"]))
    pulse = r"(?is)YTD\s+((?:20\d\d\s+)+)((?:-?\d+(?:\.\d+)?\s+)+)"
    p_years, p_all = years(F.regexp_extract(text, pulse, 1)), numbers(F.regexp_extract(text, pulse, 2))
    from_pulse = F.concat(F.filter(F.array(row(F.year(as_of), yes, F.get(p_all, F.lit(0)))), lambda r: F.size(p_all) > 0), zipped(p_years, F.slice(p_all, F.lit(2), F.greatest(F.size(p_years), F.lit(0)))))
    monthly = rf"(?is)calendar returns\s*%\s+((?:20\d\d\s+)+)YTD\s+((?:{_NUMBER}\s+)+)Fund"
    m_years, m_all = years(F.regexp_extract(text, monthly, 1)), numbers(F.regexp_extract(text, monthly, 2))
    from_monthly = F.concat(zipped(m_years, F.slice(m_all, F.lit(1), F.size(m_years))), F.array(row(F.year(as_of), yes, F.get(m_all, F.size(m_years)))))
    told = rf"(?i)return\s*for\s*(\d{{4}})\s*was\s*({_NUMBER})\s*%"
    from_facts = zipped(F.transform(F.regexp_extract_all(text, F.lit(told), F.lit(1)), lambda y: y.cast("int")), F.regexp_extract_all(text, F.lit(told), F.lit(2)))
    rows = F.when(kind == "pulse", from_pulse).when(kind == "monthly", from_monthly).otherwise(from_facts)
    return F.filter(rows, lambda r: r["year"].between(1990, 2100) & r["value"].isNotNull())


def fund_sheets(docs: DataFrame) -> DataFrame:
    """(id, kind, sectors, countries, as_of, mer, periods, years, nav, nav_date) of documents (id, text)."""
    x = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("kind", kind_of(F.col("text")))
    pick = lambda f: F.when(F.col("kind") == "pulse", f("pulse")).when(F.col("kind") == "monthly", f("monthly")).otherwise(f("facts"))
    sectors, countries = (pick(lambda k, i=i: between_marks(F.col("text"), *SECTIONS[k][i])) for i in (0, 1))
    performed = pick(lambda k: {"pulse": F.coalesce(day_after(F.col("text"), r"performance\s*\(class"), day_after(F.col("text"), "standard period returns")), "monthly": F.coalesce(day_after(F.col("text"), "performance analysis for series"), day_after(F.col("text"), "portfolio analysis as of")), "facts": day_after(F.col("text"), r"series\s+[A-Z0-9]+\s")}[k])
    allotted = pick(lambda k: {"pulse": F.coalesce(day_after(F.col("text"), r"\nallocation\s*\n"), day_after(F.col("text"), "asset mix")), "monthly": day_after(F.col("text"), "portfolio analysis as of"), "facts": day_after(F.col("text"), "investment mix|as of|as at")}[k])
    mer = F.regexp_extract("text", r"(?i)\b(?:MER|management expense ratio)\b[^0-9\n]{0,40}(\d+(?:\.\d+)?)\s*%?", 1).try_cast("double")
    # What follows the class, or the series, of a price: a sum of dollars, and in brackets its day.
    priced = F.regexp_extract("text", "(?is)NAV *[-–] *Class(.{0,80})", 1)
    dollars = lambda c: F.regexp_extract(c, r"[$] ?([0-9]+[.]?[0-9]*)", 1)
    listed = F.regexp_extract("text", "(?is)Series +[A-Z0-9]+ +NAV(.{0,30})", 1)
    x = x.withColumns({"sectors": weights(sectors), "countries": weights(countries), "performed": performed, "allotted": allotted, "mer": F.when((mer > 0) & (mer < 10), mer)})
    nav_value = F.when(F.col("kind") == "monthly", dollars(listed)).otherwise(dollars(priced)).try_cast("double")
    nav_day = F.when(F.col("kind") == "monthly", F.coalesce("performed", "allotted")).otherwise(day_after(priced, r"[(]"))
    there = (nav_value > 0) & nav_day.isNotNull()
    geo = F.when(F.col("kind") == "monthly", F.filter("countries", lambda r: r["label"].isin(*GEOGRAPHY))).otherwise(F.col("countries"))
    return x.select(
        "id", "kind", "sectors", geo.alias("countries"), F.coalesce("allotted", "performed").alias("as_of"), "mer", periods(F.col("text"), F.col("kind")).alias("periods"), calendar(F.col("text"), F.col("kind"), F.col("performed")).alias("years"),
        F.when(there, nav_value).alias("nav"), F.when(there, nav_day).alias("nav_date"),
    )


def merged_sheets(sheets: DataFrame) -> DataFrame:
    """(id, sectors, countries, as_of, document, mer, periods, years, nav, nav_date): the facts of a fund and its other document merged.

    A monthly page's lists stand before those of the facts, each for itself; a pulse page's only where the facts have none.
    What things cost comes from the facts, or the other where they do not tell; published returns from the other, those that
    it lacks from the facts; the price from the other.
    """
    by = lambda k, n: sheets.where(F.col("kind").isin(*k)).groupBy("id").agg(F.max_by(F.struct(*(c for c in sheets.columns if c != "id")), F.struct("kind", "as_of")).alias(n))
    x = by(("facts",), "f").join(by(("monthly", "pulse"), "o"), "id", "full_outer")
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    monthly = (F.col("o.kind") == "monthly") & (filled(F.col("o.sectors")) | filled(F.col("o.countries")))
    pulse = (F.col("o.kind") == "pulse") & ~filled(F.col("f.sectors")) & ~filled(F.col("f.countries")) & (filled(F.col("o.sectors")) | filled(F.col("o.countries")))
    monthly, pulse = F.coalesce(monthly, F.lit(False)), F.coalesce(pulse, F.lit(False))
    lists = lambda n: F.when(monthly & filled(F.col(f"o.{n}")), F.col(f"o.{n}")).when(pulse, F.col(f"o.{n}")).otherwise(F.col(f"f.{n}"))

    def first(n: str, *key: str) -> Column:
        own, more = (F.coalesce(F.col(f"{s}.{n}"), F.array().cast(dict(sheets.dtypes)[n])) for s in ("o", "f"))
        same = lambda a, b: F.concat_ws("|", *(a[k] for k in key)) == F.concat_ws("|", *(b[k] for k in key))
        return F.array_sort(F.concat(own, F.filter(more, lambda r: ~F.exists(own, lambda q: same(q, r)))))

    return x.select(
        "id", lists("sectors").alias("sectors"), lists("countries").alias("countries"), F.when(monthly | pulse, F.col("o.as_of")).otherwise(F.col("f.as_of")).alias("as_of"),
        F.when(monthly, "monthly").when(pulse, "pulse").when(F.col("f").isNotNull(), "facts").alias("document"), F.coalesce("f.mer", "o.mer").alias("mer"), first("periods", "period").alias("periods"), first("years", "year").alias("years"),
        F.col("o.nav").alias("nav"), F.col("o.nav_date").alias("nav_date"),
    )
