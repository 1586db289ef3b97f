"""What people type into a form's fields: values of funds, shares of a book, and whether they may be previewed or added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a form tells.
NEEDS_SHARE, NO_NUMBER, OUT_OF_RANGE, TOO_SMALL = (
    "Enter an allocation above 0% to preview or add this holding.", "Allocation must be a number.", "Allocation must be between 0 and 100.", "Enter at least 0.01%.",
)
NAV_NUMBER, NAV_POSITIVE = "New NAV must be a number", "New NAV must be a number greater than 0"
NEEDS_TICKER, NO_TICKER = "Enter a ticker and an allocation above 0% to preview this holding.", "Enter a ticker symbol, not a company name, to preview this holding."
HAS_CASH, HAS_SYMBOL, NEEDS_NAME, UNFUNDED = (
    "This model already has a cash holding — change its weight above.", "That symbol is already in this model — change its weight above.", "Enter a name before adding this holding.", "This allocation can’t be funded that way.",
)


def nav_input(raw: Column) -> Column:
    """(empty, value, error): nothing to do, a positive number, or what is wrong; dollar signs and commas are read over."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[$,\s]", "")
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    shaped = bare.rlike(r"^\+?[0-9]*\.?[0-9]+$")
    n = F.when(shaped, bare.try_cast("double"))
    error = F.when(blank, F.lit(None)).when(n.isNull(), NAV_NUMBER).when(n <= 0, NAV_POSITIVE)
    return F.struct(blank.alias("empty"), F.when(~blank & (n > 0), n).alias("value"), error.cast("string").alias("error"))


def allocation(raw: Column) -> Column:
    """(valid, value, message): a share in percent with two decimals, above 0 and at most 100."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    n = s.try_cast("double")
    n = F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)
    rounded = F.round(n.cast("decimal(20,10)"), 2).cast("double")
    message = (
        F.when(s.isin("", ".", "-", "+"), NEEDS_SHARE).when(n.isNull(), NO_NUMBER).when((n < 0) | (n > 100), OUT_OF_RANGE).when(n == 0, NEEDS_SHARE).when(rounded <= 0, TOO_SMALL)
    )
    valid = message.isNull()
    return F.struct(valid.alias("valid"), F.when(valid, rounded).when(message == TOO_SMALL, n).when(n == 0, F.lit(0.0)).alias("value"), message.alias("message"))


def preview_gate(adding: Column, raw: Column, symbol: Column, is_cash: Column) -> Column:
    """Why a preview is blocked; null where it is not. Without a holding to add there is nothing to check."""
    share, sym = allocation(raw), F.trim(F.coalesce(symbol, F.lit("")))
    return F.when(adding, F.coalesce(share["message"], F.when(~is_cash & (sym == ""), NEEDS_TICKER), F.when(~is_cash & sym.rlike(r"\s"), NO_TICKER)))


def add_gate(raw: Column, has_cash: Column, has_symbol: Column, needs_name: Column, can_add: Column, warning: Column) -> Column:
    """Why a holding cannot be added; null where it can."""
    return F.coalesce(
        allocation(raw)["message"], F.when(has_cash, HAS_CASH), F.when(has_symbol, HAS_SYMBOL), F.when(needs_name, NEEDS_NAME), F.when(~F.coalesce(can_add, F.lit(True)), F.coalesce(warning, F.lit(UNFUNDED)))
    )
