"""Rows of filing indexes as their searches answer them: lists of cells, or records with a link in HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import loose_date

# Where the senate's search lives, and where a document can be asked for.
SENATE, COLLECTION = "https://efdsearch.senate.gov", "https://www.oge.gov/web/OGE.nsf/Officials%20Individual%20Disclosures%20Search%20Collection?OpenForm"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def link_of(html: Column) -> Column:
    """The first link's address; null without one."""
    return F.nullif(F.replace(F.regexp_extract(html, r"""(?i)href=["']([^"']+)["']""", 1), F.lit("&amp;"), F.lit("&")), F.lit(""))


def label_of(html: Column) -> Column:
    """Text without tags, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def senate_row(cells: Column, annual: bool = False) -> Column:
    """(filing_key, first, last, filer, filed_date, kind, report_year, filing_kind, url) of (first, last, filer, link, date); null where it is no such report.

    kind: paper for a scan, else ptr, or annual for annual reports, whose label holds the year and whether it amends.
    """
    cell = lambda i: F.trim(F.coalesce(F.get(cells, F.lit(i)), F.lit("")))
    path, label = link_of(cell(3)), label_of(cell(3))
    key = F.nullif(F.lower(F.regexp_extract(path, rf"/(?:{'annual' if annual else 'ptr'}|paper)/({UUID})/", 1)), F.lit(""))
    year = F.nullif(F.regexp_extract(label, r"(20\d\d)", 1), F.lit("")).cast("int")
    row = F.struct(
        key.alias("filing_key"), cell(0).alias("first"), cell(1).alias("last"), cell(2).alias("filer"), loose_date(cell(4)).alias("filed_date"), F.when(path.contains("/paper/"), "paper").otherwise("annual" if annual else "ptr").alias("kind"),
        (year if annual else F.lit(None).cast("int")).alias("report_year"), (F.when(F.lower(label).contains("amendment"), "amendment").otherwise("original") if annual else F.lit(None).cast("string")).alias("filing_kind"),
        F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(SENATE), path)).alias("url"),
    )
    is_one = F.lower(label).contains("annual") if annual else F.lit(True)
    return F.when((F.size(cells) >= 5) & key.isNotNull() & is_one, row)


def office_of(title: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return F.when(t == "president", "president").when(t == "vice president", "vice-president")


def executive_row(kind: Column, title: Column, name: Column, date: Column, annual: bool = False) -> Column:
    """(filing_key, first, last, office, filed_date, report_year, filing_kind, request, url) of a record; null where it is no such report.

    A document that is not posted is a request, and has a key of its name and date.
    """
    label, url = label_of(kind), link_of(kind)
    lower = F.lower(label)
    request = url.isNull() | lower.contains("request this document") | url.rlike(r"(?i)201(?:%20|\s)request")
    whole = F.trim(F.coalesce(name, F.lit("")))
    comma = F.instr(whole, ",")
    last = F.when(comma > 0, F.trim(F.left(whole, comma - 1))).otherwise(whole)
    first = F.when(comma > 0, F.trim(F.substring(whole, comma + 1, F.length(whole)))).otherwise("")
    day = F.left(F.coalesce(date, F.lit("")), F.lit(10))
    filed = F.when(day.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(day, "yyyy-MM-dd"))
    posted = F.nullif(F.upper(F.regexp_extract(F.regexp_replace(url, "(?i)%2B", "+"), r"(?i)/([A-F0-9]{16,})/\$FILE/", 1)), F.lit(""))
    own = F.concat(F.lit("annual:" if annual else "request:"), F.lower(whole), F.lit(":"), F.coalesce(F.date_format(filed, "yyyy-MM-dd"), F.lit("undated")))
    office = office_of(title)
    is_one = lower.contains("annual") & ~lower.contains("transaction") & office.isNotNull() if annual else lower.rlike(r"278\s*transaction")
    year = F.nullif(F.regexp_extract(lower, r"annual\s*\((20\d\d)\)", 1), F.lit("")).cast("int")
    row = F.struct(
        F.coalesce(F.when(~request, posted), own).alias("filing_key"), first.alias("first"), last.alias("last"), office.alias("office"), filed.alias("filed_date"), (year if annual else F.lit(None).cast("int")).alias("report_year"),
        (F.when(lower.contains("amendment"), "amendment").otherwise("original") if annual else F.lit(None).cast("string")).alias("filing_kind"), request.alias("request"), F.coalesce(url, F.lit(COLLECTION)).alias("url"),
    )
    return F.when(is_one, row)
