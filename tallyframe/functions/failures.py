"""What failed look-ups mean: kinds of attempts, verdicts over several, answers of sources, and outcomes of a refresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by which messages are told apart.
SPENT = ("rate limit", "too many requests", "api credits", "quota exceeded", "daily cap", "daily limit", "request per minute", "requests per minute", "request per day", "requests per day")
REFUSED = ("refus", "block", "rate", "limit", "forbidden", "too many")
NO_KEY = ("_api_key not configured", "api key not configured", "missing api key")
UNKNOWN = ("no data", "not found", "notfound", "does not know", "no close price", "no quote data", "no candle", "no rows", "unknown symbol")
UNREACHABLE = ("network", "unreachable", "timeout", "econn", "enotfound", "fetch failed", "block page", "non-json", "aborted", "socket")
BLOCK_PAGES = ("<html", "<!doctype", "just a moment", "enable javascript", "cf-browser", "challenge-platform", "proof of work", "attention required")
#: Kinds that say nothing about the symbol.
TRANSIENT = ("rate-limit", "missing-key", "unreachable")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda c, w: c | text.contains(w), words, F.lit(False))


def _names_status(text: Column, *codes: int) -> Column:
    return text.rlike(rf"\bhttp\s*(?:{'|'.join(map(str, codes))})\b")


def is_spent(message: Column, status: Column) -> Column:
    """Whether a source has refused for now: too many requests, forbidden, or a quota that is used up."""
    m = F.lower(F.coalesce(message, F.lit("")))
    spent = F.regexp_extract(m, "out of (.{0,67})", 1).contains("credits")
    told = _names_status(m, 429, 403) | (m.rlike(r"\b(?:429|403)\b") & _has(m, REFUSED)) | _has(m, SPENT) | spent
    # This source says so in a message beside an answer that is in order.
    said = F.trim(F.substring_index(F.concat(m, F.lit("alpha vantage:")), "alpha vantage:", -2))
    free_key = m.contains("alpha vantage:") & (said.startswith("note") | said.startswith("information") | _has(said, ("limit", "premium")))
    return F.coalesce(status.isin(429, 403), F.lit(False)) | told | free_key


def attempt_kind(message: Column, status: Column, not_found: Column, skipped: Column) -> Column:
    """rate-limit (skipped ones too), missing-key, not-found, unreachable or other."""
    m = F.lower(F.coalesce(message, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(skipped) | m.contains("cooling down") | is_spent(message, status), "rate-limit").when(_has(m, NO_KEY), "missing-key")
        .when(yes(not_found) | _has(m, UNKNOWN), "not-found").when(_has(m, UNREACHABLE), "unreachable").otherwise("other")
    )


def attempts_verdict(kinds: Column) -> Column:
    """(any_not_found, any_rate_limit, all_transient, allow_auto, all_not_found) of an array of kinds; no attempt allows nothing."""
    some, n = F.size(kinds) > 0, F.array_contains(kinds, "not-found")
    limited, transient = F.array_contains(kinds, "rate-limit"), some & F.forall(kinds, lambda k: k.isin(*TRANSIENT))
    return F.struct(
        n.alias("any_not_found"), limited.alias("any_rate_limit"), transient.alias("all_transient"), (transient & limited & ~n).alias("allow_auto"), (some & F.forall(kinds, lambda k: k == "not-found")).alias("all_not_found")
    )


def add_source(found: Column, allow_auto: Column, manual_nav: Column) -> Column:
    """Where a new holding's prices come from: an entered value first, else the market if it answered or may answer later."""
    return F.when(manual_nav, "manual").when(found | allow_auto, "auto").otherwise("manual")


def failure_code(message: Column, status: Column, not_found: Column) -> Column:
    """(code, status) of a price source's failure: rate_limit, not_found or blocked."""
    m = F.lower(F.coalesce(message, F.lit("")))
    of = lambda code, s: F.struct(F.lit(code).alias("code"), s.cast("int").alias("status"))
    limited = F.coalesce(status == 429, F.lit(False)) | _names_status(m, 429) | m.contains("too many requests") | m.rlike("rate.?limit")
    unknown = (m.contains("does not know") | m.contains("no data found") | m.rlike(r"not\s*found")) & ~_has(m, ("429", "403", "refus", "block"))
    barred = F.coalesce(status.isin(401, 403), F.lit(False)) | _names_status(m, 401, 403) | _has(m, ("refus", "block"))
    return F.when(limited, of("rate_limit", F.lit(429))).when(F.coalesce(not_found, F.lit(False)) | unknown, of("not_found", F.lit(404))).otherwise(of("blocked", F.coalesce(F.nullif(status, F.lit(0)), F.when(barred, 403).otherwise(502))))


def response_kind(status: Column, body: Column, server: Column) -> Column:
    """blocked (an answer that denies access), transient (too many requests, an error of the server) or ok."""
    text, host, code = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(server, F.lit(""))), F.coalesce(status, F.lit(0))
    denied = text.contains("access denied") | text.contains("you don't have permission to access")
    edge = _has(text, ("akamai", "edgesuite")) | host.contains("akamai") | text.rlike(r"reference\s*#\s*\d")
    return F.when((code == 403) | (denied & (edge | (code == 503))), "blocked").when((code == 429) | (code >= 500), "transient").otherwise("ok")


def is_block_page(body: Column, status: Column) -> Column:
    """Whether a table's source sent a page for people instead."""
    return F.coalesce(status.isin(403, 429, 503), F.lit(False)) | _has(F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(2500))), BLOCK_PAGES)


def refresh_outcome(waiting: Column, answered: Column, stale: Column, before: Column, after: Column, kinds: Column, skipped: Column) -> Column:
    """(status, reason) of refreshing a holding's prices.

    waiting: it is held back after a miss; answered: there are prices; stale: they come from a cache; before, after: the last
    dates; kinds: of the attempts; skipped: how many of them were passed over. All passed over is a cooldown, not a failure.
    """
    of = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.cast("string").alias("reason"))
    v, none = attempts_verdict(kinds), F.lit(None)
    reason = F.when(v["all_not_found"], "not-found").when(v["any_rate_limit"], "rate-limit").otherwise("total-miss")
    held = (F.size(kinds) > 0) & (skipped == F.size(kinds))
    return (
        F.when(waiting, of("cooldown", F.lit("backed-off"))).when((~answered | stale) & held, of("cooldown", F.lit("provider-cooldown"))).when(~answered, of("failed", F.lit("total-miss")))
        .when(stale, of("failed", reason)).when(after.isNotNull() & ~after.eqNullSafe(before), of("updated", none)).otherwise(of("unchanged", none))
    )
