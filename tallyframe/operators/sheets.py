"""Price sheets as people paste or upload them: prices by the header's columns or by their number, dividends, splits, and what was passed over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import detected_currency, detected_ticker, same_listing
from ..functions.text import loose_date
from ..sources.kept import kept
from .extract import lines

# Columns of a sheet by how many numbers a row has, where no header says.
BY_COUNT = {1: ["close"], 2: ["close", "adj"], 4: ["open", "high", "low", "close"], 5: ["open", "high", "low", "close", "adj"], 6: ["open", "high", "low", "close", "adj", "volume"]}
# Words of a page around its table.
AROUND = ("historical prices", "related tickers", "currency in", "delayed quote", "copyright", "premium plans", "all rights reserved")
# A move between neighbouring days that is worth a warning, and how far apart these may be.
SUDDEN, NEIGHBOURS = 0.4, 5
#: Days of a preview's head and tail.
ENDS = 5
HEADINGS = {"date": "date", "open": "open", "high": "high", "low": "low", "close": "close", "adjclose": "adj", "volume": "volume", "vol": "volume"}
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATED = rf"(?i)^({MONTH} +\d{{1,2}}, +20\d\d|\d{{4}}-\d\d-\d\d|\d{{1,2}}/\d{{1,2}}/20\d\d)"
FIELDS = "abcdefgh"


def _header(line: Column) -> Column:
    """The names of a header's columns, in order; null where it has no date and close, and for lines that begin with a date."""
    joined = F.regexp_replace(line, r"(?i)adj\.? *close", "AdjClose")
    parts = F.split(joined, F.when(joined.contains(",") & ~joined.rlike(r"\s{2,}"), ",").otherwise(r"\s+"))
    known = F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))
    keys = F.filter(F.transform(parts, lambda p: F.try_element_at(known, F.regexp_replace(F.lower(p), "[^a-z]", ""))), lambda k: k.isNotNull())
    return F.when(~line.rlike(DATED) & F.array_contains(keys, "date") & F.array_contains(keys, "close"), F.array_remove(keys, "date"))


def _value(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[$,]", "").try_cast("double")


def sheet_rows(docs: DataFrame) -> DataFrame:
    """(id, line_no, date, kind, close, adj, amount, raw) of the dated lines of texts (id, text).

    kind: point, dividend, split, incomplete (words, or no price where the columns say) or invalid (no date of the calendar).
    Fields of comma separated rows may be quoted; in other rows commas part thousands.
    """
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(docs.select("id", F.regexp_replace("text", "^﻿", "").alias("text"))).select("id", "line_no", F.trim("line").alias("line"))
    x = x.withColumn("head", F.last(_header(F.col("line")), ignorenulls=True).over(w)).withColumn("_date", F.regexp_extract("line", DATED, 1)).where("_date <> ''")
    x = x.where(~reduce(lambda c, p: c | F.lower("line").contains(p), AROUND, F.lit(False)))
    rest = F.substring(F.col("line"), F.length("_date") + 1, F.length("line"))
    x = x.select("id", "line_no", "head", F.col("line").alias("raw"), loose_date(F.col("_date")).alias("date"), rest.alias("rest"))
    fields = F.from_csv(F.substring("rest", 2, 1 << 20), F.lit(", ".join(f"{f} string" for f in FIELDS)))
    is_csv = F.col("rest").startswith(",")
    listed = F.array(*(_value(fields[f]) for f in FIELDS))
    loose = F.filter(F.transform(F.split(F.trim("rest"), r"\s+"), _value), lambda n: n.isNotNull())
    x = x.withColumns({"_csv": is_csv, "v": F.when(is_csv & F.col("head").isNotNull(), listed).when(is_csv, F.filter(listed, lambda n: n.isNotNull())).otherwise(loose)})
    n = F.least(F.size("v"), F.lit(6))
    counted = F.try_element_at(F.create_map(*(c for k, names in BY_COUNT.items() for c in (F.lit(k), F.array(*map(F.lit, names))))), n)
    fits = F.col("_csv") | F.col("head").isNull() | (F.size("v") <= F.size("head"))
    keys = F.when(fits, F.coalesce("head", counted))
    at = lambda name: F.get("v", F.array_position(keys, name).cast("int") - 1)
    close, adj = F.when(F.array_contains(keys, "close"), at("close")), F.when(F.array_contains(keys, "adj"), at("adj"))
    kind = (
        F.when(F.col("date").isNull(), "invalid").when(F.lower("raw").contains("dividend"), "dividend").when(F.lower("rest").contains("split"), "split")
        .when(F.col("rest").rlike("[A-Za-z]") | ~F.coalesce(close > 0, F.lit(False)), "incomplete").otherwise("point")
    )
    amount = F.when(kind == "dividend", F.get(loose, F.lit(0)))
    point = lambda c: F.when((kind == "point") & (c > 0), c)
    return x.select("id", "line_no", "date", kind.alias("kind"), point(close).alias("close"), point(adj).alias("adj"), amount.alias("amount"), "raw")


def price_sheet(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, date, close, adj, sudden), one row a day, the last of it; (id, date, kind, amount, raw) of dividends and splits; and (id,
    points, dividends, splits, incomplete, duplicates, invalid, unlike) of every text; unlike: days given twice with two prices.
    """
    rows = kept(sheet_rows(docs), "rows")
    days = rows.where("kind = 'point'").groupBy("id", "date").agg(
        F.max_by(F.struct("close", "adj"), "line_no").alias("p"), F.count("*").alias("n"), (F.min("close") < F.max("close")).alias("two")
    )
    days = kept(days, "days")
    w = Window.partitionBy("id").orderBy("date")
    moved = F.abs(F.col("p.close") / F.lag("p.close").over(w) - 1) > SUDDEN
    near = F.datediff("date", F.lag("date").over(w)) <= NEIGHBOURS
    points = days.select("id", "date", "p.close", "p.adj", F.coalesce(moved & near, F.lit(False)).alias("sudden"))
    events = rows.where("kind in ('dividend', 'split')").select("id", "date", "kind", "amount", "raw")
    kinds = rows.groupBy("id").agg(*(F.count_if(F.col("kind") == k).alias(a) for k, a in (("dividend", "dividends"), ("split", "splits"), ("incomplete", "incomplete"), ("invalid", "invalid"))))
    same = days.groupBy("id").agg(F.count("*").alias("points"), (F.sum("n") - F.count("*")).alias("duplicates"), F.count_if("two").alias("unlike"))
    counts = docs.select("id").join(kinds.hint("merge"), "id", "left").join(same.hint("merge"), "id", "left")
    return points, events, counts.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("points", "dividends", "splits", "incomplete", "duplicates", "invalid", "unlike")))


def preview(docs: DataFrame, existing: DataFrame, holdings: DataFrame) -> DataFrame:
    """What an upload (id, text) would do to its holding (id, symbol, currency), a row each: its ticker and currency, how many days it has and from
    when to when, the first and last five of more than ten, whether the ticker is the holding's (null: it names none), whether the currencies differ, and
    how many days are added, changed and unchanged beside those that exist (id, date, close).
    """
    points, _, counts = price_sheet(docs)
    one = F.struct("date", "close", "adj")
    series = points.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("s"), F.count_if("sudden").alias("sudden"))
    old = existing.select("id", "date", F.col("close").alias("_old"))
    both = points.select("id", "date", "close").join(old.hint("merge"), ["id", "date"], "left")
    overlap = both.groupBy("id").agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_old") != F.col("close")).alias("changed"), F.count_if(F.col("_old") == F.col("close")).alias("unchanged"))
    told = docs.select("id", detected_ticker(F.col("text")).alias("ticker"), detected_currency(F.col("text")).alias("currency"))
    # A row for each upload on every side: none of them is small enough for the driver, whatever their files' size says.
    skipped = counts.select("id", (F.col("dividends") + F.col("splits") + F.col("incomplete") + F.col("duplicates") + F.col("invalid")).alias("skipped"))
    x = told.join(holdings.select("id", "symbol", F.col("currency").alias("_held")).hint("merge"), "id", "left").join(series.hint("merge"), "id", "left").join(overlap.hint("merge"), "id", "left").join(skipped.hint("merge"), "id")
    n = F.coalesce(F.size("s"), F.lit(0))
    ends = n > 2 * ENDS
    none = F.array().cast(x.schema["s"].dataType)
    part = lambda first, many: F.slice("s", first, many)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select(
        "id", "ticker", "currency", F.when(n > 0, n).otherwise(0).cast("long").alias("rows"), F.get("s", F.lit(0))["date"].alias("first_date"), F.get("s", n - 1)["date"].alias("last_date"), F.get("s", n - 1)["close"].alias("last_close"),
        F.coalesce(F.when(ends, part(1, ENDS)).otherwise(F.col("s")), none).alias("head"), F.when(ends, part(-ENDS, ENDS)).otherwise(none).alias("tail"),
        F.when(F.col("ticker").isNotNull() & F.col("symbol").isNotNull(), same_listing(F.col("ticker"), F.col("symbol"))).alias("ticker_match"), F.coalesce(F.upper("currency") != F.upper("_held"), F.lit(False)).alias("currency_mismatch"),
        number("skipped"), number("sudden"), number("added"), number("changed"), number("unchanged"),
    )
