"""Queries on failed look-ups: what events would mean as attempts to fetch a price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import failures
from ..sources.tables import Tables
from ..streaming import backoff
from .registry import query

#: An attempt for each event: its message and status by type and value, in SQL of both engines.
MESSAGE = """case event_type when 'error' then case when value < 40 then 'HTTP 403 from host' when value < 60 then 'Daily limit' when value < 90 then 'socket closed' else 'odd answer' end
 when 'signup' then 'unknown symbol' when 'click' then case when value < 50 then 'RATE LIMIT reached' else 'missing API key' end when 'view' then 'is cooling down' end"""
STATUS = "case when event_type = 'error' and value > 200 then 429 when event_type = 'error' and value > 120 then 503 when event_type = 'click' and value > 150 then 500 end"
KIND = f"""case when event_type = 'view' or {STATUS} in (429, 403) or (event_type = 'error' and value < 60) or (event_type = 'click' and value < 50) then 'rate-limit'
 when event_type = 'click' then 'missing-key' when event_type = 'signup' then 'not-found' when event_type = 'error' and value < 90 then 'unreachable' else 'other' end"""


def attempts(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts", "event_type", "value", F.expr(MESSAGE).alias("message"), F.expr(STATUS).alias("status"))
    return e.withColumn("kind", failures.attempt_kind(F.col("message"), F.col("status"), F.lit(False), F.col("event_type") == "view"))


@query("rec13_attempt_kinds", f"select event_id, {KIND} as kind from events")
def _(t: Tables) -> DataFrame:
    return attempts(t).select("event_id", "kind")


@query("rec13_verdicts", f"""with k as (select user_id, ts::date as day, list({KIND} order by event_id) as kinds, bool_or(value > 195) as found, bool_or(value > 199) as manual from events group by 1, 2),
v as (select *, list_contains(kinds, 'not-found') as any_not_found, list_contains(kinds, 'rate-limit') as any_rate_limit, len(list_filter(kinds, lambda k: k not in ('rate-limit', 'missing-key', 'unreachable'))) = 0 as all_transient from k)
select user_id, day, any_not_found, any_rate_limit, all_transient, all_transient and any_rate_limit as allow_auto, len(list_filter(kinds, lambda k: k <> 'not-found')) = 0 as all_not_found,
case when manual then 'manual' when found or (all_transient and any_rate_limit) then 'auto' else 'manual' end as source from v""")
def _(t: Tables) -> DataFrame:
    x = attempts(t).groupBy("user_id", F.to_date("ts").alias("day")).agg(failures.attempts_verdict(F.collect_list("kind")).alias("v"), F.bool_or(F.col("value") > 195).alias("found"), F.bool_or(F.col("value") > 199).alias("manual"))
    return x.select("user_id", "day", "v.*", failures.add_source(F.col("found"), F.col("v.allow_auto"), F.col("manual")).alias("source"))


@query("rec14_failure_codes", f"""with e as (select event_id, event_type, value, {STATUS} as status from events)
select event_id, case when status = 429 or (event_type = 'click' and value < 50) then 'rate_limit' when false then 'not_found' else 'blocked' end as code,
case when status = 429 or (event_type = 'click' and value < 50) then 429 when status is not null then status when event_type = 'error' and value < 40 then 403 else 502 end::int as status from e where event_type <> 'signup'
union all select event_id, case when value < 100 then 'not_found' else 'blocked' end, case when value < 100 then 404 else 403 end from e where event_type = 'signup'""")
def _(t: Tables) -> DataFrame:
    told = F.when(F.col("event_type") == "signup", F.when(F.col("value") < 100, "ABC was not found").otherwise("not found, HTTP 403")).otherwise(F.col("message"))
    return attempts(t).select("event_id", failures.failure_code(told, F.col("status"), F.lit(False)).alias("c")).select("event_id", "c.*")


@query("rec14_responses", """with r as (select event_id, event_type, case when value > 190 then 403 when value > 150 then 503 when value > 120 then 429 else 200 end as status, event_type in ('error', 'click') as denied, event_type in ('error', 'view') as edge from events)
select event_id, case when status = 403 or (denied and (edge or status = 503)) then 'blocked' when status in (503, 429) then 'transient' else 'ok' end as kind, status <> 200 or event_type = 'signup' as block_page from r""")
def _(t: Tables) -> DataFrame:
    status = F.expr("case when value > 190 then 403 when value > 150 then 503 when value > 120 then 429 else 200 end")
    kind = F.col("event_type")
    body = F.concat(F.when(kind.isin("error", "click"), "Access Denied. ").otherwise("fine. "), F.when(kind == "error", "Reference # 18.2").when(kind == "signup", "<!DOCTYPE html>").otherwise(""))
    server = F.when(kind == "view", "AkamaiGHost")
    return t.events.select("event_id", failures.response_kind(status, body, server).alias("kind"), failures.is_block_page(body, status).alias("block_page"))


@query("rec21_refresh_outcomes", f"""with k as (select event_type as symbol, ts::date as day, list({KIND} order by event_id) as kinds, count(*) filter (event_type = 'view')::bigint as skipped, max(value) as high, min(value) as low from events group by 1, 2),
p as (select *, lag(day) over (partition by symbol order by day) as before from k),
o as (select symbol, day, low < 2 as waiting, high > 60 as answered, high < 100 as stale, before, case when low < 5 then before else day end as after, kinds, skipped from p)
select symbol, day, case when waiting then 'cooldown' when (not answered or stale) and skipped = len(kinds) then 'cooldown' when not answered or stale then 'failed' when after is not null and after is distinct from before then 'updated' else 'unchanged' end as status,
case when waiting then 'backed-off' when (not answered or stale) and skipped = len(kinds) then 'provider-cooldown' when not answered then 'total-miss' when stale then case when len(list_filter(kinds, lambda k: k <> 'not-found')) = 0 then 'not-found' when list_contains(kinds, 'rate-limit') then 'rate-limit' else 'total-miss' end end as reason from o""")
def _(t: Tables) -> DataFrame:
    x = attempts(t).groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(
        F.collect_list("kind").alias("kinds"), F.count_if(F.col("event_type") == "view").alias("skipped"), F.max("value").alias("high"), F.min("value").alias("low")
    )
    x = x.withColumn("before", F.lag("day").over(Window.partitionBy("symbol").orderBy("day")))
    after = F.when(F.col("low") < 5, F.col("before")).otherwise(F.col("day"))
    return x.select("symbol", "day", failures.refresh_outcome(F.col("low") < 2, F.col("high") > 60, F.col("high") < 100, F.col("before"), after, F.col("kinds"), F.col("skipped")).alias("o")).select("symbol", "day", "o.*")


def price_attempts(t: Tables) -> DataFrame:
    """(key, ts, reason, known, resumes): 36 attempts a day and user, so that waits overlap them."""
    kind = F.col("event_type")
    reason = F.when(kind == "error", "rate-limit").when((kind == "signup") & (F.col("value") > 100), "not-found").when(kind == "view", backoff.ALL_WAIT).when(kind == "click", "total-miss")
    squeezed = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp_ltz")) / 400).cast("bigint"))
    resumes = F.when(F.col("event_id") % 2 == 0, F.timestamp_micros(F.unix_micros(squeezed) + F.lit(5 * backoff.MINUTE)))
    return t.events.select(F.col("user_id").cast("string").alias("key"), squeezed.alias("ts"), reason.alias("reason"), (F.col("user_id") % 3 != 0).alias("known"), resumes.alias("resumes"))


@query("stm08_price_waits", f"""with recursive e as (select user_id::varchar as key, epoch_us(ts) // 400 as ts, case event_type when 'error' then 'rate-limit' when 'view' then '{backoff.ALL_WAIT}' when 'click' then 'total-miss' when 'signup' then case when value > 100 then 'not-found' end end as reason,
  user_id % 3 <> 0 as known, case when event_id % 2 = 0 then epoch_us(ts) // 400 + {5 * backoff.MINUTE} end as resumes from events), a as (select *, row_number() over (partition by key order by ts, reason nulls first, known, resumes nulls first) as n from e),
f as (select key, 0::bigint as n, 0::bigint as ts, '' as action, null::bigint as until, 0::bigint as strikes, null::varchar as reason from a where n = 1
union all select a.key, a.n, a.ts, case when a.ts < f.until then 'skipped' when a.reason is null then 'ok' else 'miss' end,
  case when a.ts < f.until then f.until when a.reason is null then null when a.reason = 'not-found' then a.ts + {24 * 60 * backoff.MINUTE}
    else a.ts + least({20 * backoff.MINUTE} * (1 << least(f.strikes, 8)), case when a.known then {180 * backoff.MINUTE} else {30 * backoff.MINUTE} end, case when a.reason = '{backoff.ALL_WAIT}' and a.resumes > a.ts then a.resumes - a.ts else {180 * backoff.MINUTE} end) end,
  case when a.ts < f.until then f.strikes when a.reason is null then 0 when a.reason = '{backoff.ALL_WAIT}' then f.strikes else f.strikes + 1 end, case when a.ts < f.until then f.reason else a.reason end from f join a on a.key = f.key and a.n = f.n + 1)
select key, ts, action, until, strikes::int as strikes, reason from f where n > 0""")
def _(t: Tables) -> DataFrame:
    out = backoff.replay(price_attempts(t))
    return out.select("key", F.unix_micros("ts").alias("ts"), "action", F.unix_micros("until").alias("until"), "strikes", "reason")


@query("dat15_waits", f"""with x as (select event_id, event_id % 12 - 1 as n, case event_id % 3 when 0 then '429' when 1 then 'blocked' else 'not-found' end as reason, event_id % 5 <> 0 as known from events)
select event_id, case reason when 'not-found' then {24 * 60} else least(20 * (1 << least(greatest(n, 0), 8)), case when known then 180 else 30 end) end::bigint as price_minutes, case reason when 'blocked' then {12 * 60} else least(case reason when '429' then 15 else 5 end * (1 << least(greatest(n, 0), 6)), 360) end::bigint as source_minutes from x""")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id")
    strikes, reason, known = (k % 12 - 1).cast("int"), F.element_at(F.array(*map(F.lit, ("429", "blocked", "not-found"))), (k % 3 + 1).cast("int")), k % 5 != 0
    minutes = lambda p: F.floor(backoff.waits(p, strikes, reason, known) / backoff.MINUTE)
    return t.events.select("event_id", minutes(backoff.PRICES).alias("price_minutes"), minutes(backoff.SOURCES).alias("source_minutes"))
