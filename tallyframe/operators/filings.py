"""Rows that filings are stored as: heads of periodic and annual reports, their trades, and their holdings with matched tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_ticker, person_key
from .names import match_names

# What a report may say its filer is; classes of holdings that never get a ticker; classes of matched names.
FILERS = ("member", "candidate", "officer", "employee")
UNMATCHED = ("bond", "cash", "real_estate", "private", "retirement", "crypto")
MATCHED_CLASSES = {"etf": "etf_fund", "fund": "etf_fund", "bond": "bond", "crypto": "crypto", "stock": "stock"}


def state_of(district: Column) -> Column:
    """(state, district) of two letters and two digits; nulls for anything else."""
    good = district.rlike("^[A-Z]{2}[0-9]{2}$")
    return F.struct(F.when(good, F.left(district, F.lit(2))).alias("state"), F.when(good, F.right(district, F.lit(2))).alias("district"))


def filer_status(printed: Column, prefix: Column, matched: Column) -> Column:
    """What the report says; else a member if the roster has just one such person, or the index says Hon.; else a candidate."""
    said = F.lower(F.trim(F.coalesce(printed, F.lit(""))))
    honoured = F.lower(F.trim(F.coalesce(prefix, F.lit("")))).isin("hon", "hon.")
    return F.when(said.isin(*FILERS), said).when(F.coalesce(matched, F.lit(False)) | honoured, "member").otherwise("candidate")


def percent_of(confidence: Column) -> Column:
    """A whole number from 0 to 100, null where there is none."""
    return F.when(confidence.isNotNull() & ~F.isnan(confidence.cast("double")), F.greatest(F.lit(0), F.least(F.lit(100), F.round(confidence.cast("double"), 0).cast("int"))))


def filing_records(heads: DataFrame, annual: bool = False) -> DataFrame:
    """heads (source, filing_key, first, last, office, filer_status, status and others) as stored: with id, person_key and
    person_name; outside the house a filer without a status is a member; a report without a status needs a reader.

    annual: ids begin with "annual:", and kind is original unless it is amendment (kind, report_year, excluded, unreadable are read).
    """
    name = F.trim(F.regexp_replace(F.concat_ws(" ", F.trim("first"), F.trim("last")), r"\s+", " "))
    new = {
        "id": F.concat_ws(":", *([F.lit("annual")] if annual else []), "source", "filing_key"), "person_key": person_key(F.col("office"), F.col("last"), F.col("first")),
        "person_name": F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")), "filer_status": F.coalesce("filer_status", F.when(F.col("office") != "house", "member")),
        "status": F.coalesce("status", F.lit("needs_manual_review")),
    }
    if annual:
        new |= {"kind": F.when(F.col("kind") == "amendment", "amendment").otherwise("original"), **{c: F.coalesce(c, F.lit(0)) for c in ("excluded", "unreadable")}}
    return heads.withColumns(new)


def trade_rows(records: DataFrame, trades: DataFrame) -> DataFrame:
    """The trades (id, nth, ticker, ...) of stored filings: numbered from 1 by nth, with what they take from their filing.

    Ids are those of the filing and the number, so reading a filing again changes nothing. A printed ticker comes from the
    filing unless the trade says otherwise.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("id").orderBy("nth"))
    head = records.select(F.col("id").alias("filing_id"), "person_key", "person_name", "office", "party", "filer_status", "filed_date")
    x = trades.withColumn("row_index", n).withColumnRenamed("id", "filing_id").drop("nth").join(head, "filing_id")
    return x.withColumns({
        "id": F.concat_ws(":", "filing_id", "row_index"), "ticker_norm": canonical_ticker(F.col("ticker")), "class": F.coalesce("class", F.lit("other")), "partial": F.coalesce("partial", F.lit(False)),
        "disclosed_date": F.col("filed_date"), "lag_days": F.datediff("filed_date", "date"), "ticker_source": F.coalesce("ticker_source", F.when(F.col("ticker").isNotNull(), "filing")), "confidence": percent_of(F.col("confidence")),
    }).drop("filed_date")


def annotated_holdings(holdings: DataFrame, **catalog: DataFrame) -> DataFrame:
    """holdings (id, asset, ticker, class, code) with ticker_source and confidence: a printed ticker stays; classes that no
    ticker fits, and options, get none; others are matched by name, and a class of "other" becomes that of the match.
    """
    printed = canonical_ticker(F.col("ticker"))
    asset = F.coalesce("asset", F.lit(""))
    barred = F.coalesce(F.col("class").isin(*UNMATCHED), F.lit(False)) | F.coalesce(F.col("code") == "OP", F.lit(False)) | asset.rlike(r"(?i)\b(?:call|put|option)s?\b")
    x = holdings.withColumns({"ticker": printed, "_open": printed.isNull() & ~barred})
    found = match_names(x.where("_open").select("id", F.col("asset").alias("name")), **catalog).where("ticker is not null")
    found = found.select("id", F.col("ticker").alias("_ticker"), F.col("class").alias("_class"), F.col("confidence").alias("_confidence"))
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(s) for kv in MATCHED_CLASSES.items() for s in kv)), F.col("_class")), F.lit("other"))
    x = x.join(found, "id", "left")
    own = F.coalesce("class", F.lit("other"))
    return x.withColumns({
        "ticker_source": F.when(F.col("ticker").isNotNull(), "filing").when(F.col("_ticker").isNotNull(), "name_match"), "class": F.when(F.col("_ticker").isNotNull() & (own == "other"), kind).otherwise(own),
        "ticker": F.coalesce("ticker", "_ticker"), "confidence": F.col("_confidence"),
    }).drop("_open", "_ticker", "_class", "_confidence")
