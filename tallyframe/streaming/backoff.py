"""Waiting after misses: one rule, folded over each key's attempts in batch and run as keyed state with timers on a stream.

A miss sets a wait that doubles with each one before it (strikes), up to a limit; some reasons have a wait of their own. An
attempt within the wait is passed over and changes nothing. An answer clears strikes and wait. Where all sources were
themselves waiting, the miss is no strike, and the wait ends when the first of them is ready. Times are in microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
#: An attempt's reason where every source was waiting.
ALL_WAIT = "provider-cooldown"


@dataclass(frozen=True)
class Policy:
    """Waits in microseconds. fixed: reasons with one wait, and whether they count as a strike or set strikes to 0."""

    base: dict[str, int]
    longest: int
    longest_unknown: int
    most_doublings: int
    fixed: dict[str, tuple[int, bool]] = field(default_factory=dict)


# Waits after a holding's price was missed, and after a source of filings failed. "": any other reason.
PRICES = Policy({"": 20 * MINUTE}, 180 * MINUTE, 30 * MINUTE, 8, {"not-found": (24 * 60 * MINUTE, True)})
SOURCES = Policy({"429": 15 * MINUTE, "": 5 * MINUTE}, 360 * MINUTE, 360 * MINUTE, 6, {"blocked": (12 * 60 * MINUTE, False)})

ATTEMPT = "key string, ts timestamp, reason string, known boolean, resumes timestamp"
STEP = "key string, ts timestamp, action string, until timestamp, strikes int, reason string"
STATE = "until bigint, strikes int, reason string"


def next_state(policy: Policy, until: int | None, strikes: int, held: str | None, ts: int, reason: str | None, known: bool, resumes: int | None) -> tuple[str, int | None, int, str | None]:
    """(action, until, strikes, reason) after an attempt; reason null: it was answered."""
    if until is not None and ts < until:
        return "skipped", until, strikes, held
    if reason is None:
        return "ok", None, 0, None
    if reason in policy.fixed:
        wait, counts = policy.fixed[reason]
        return "miss", ts + wait, strikes + 1 if counts else 0, reason
    wait = min(policy.base.get(reason, policy.base[""]) << min(strikes, policy.most_doublings), policy.longest if known else min(policy.longest, policy.longest_unknown))
    if reason == ALL_WAIT:
        if resumes is not None and resumes > ts:
            wait = min(wait, resumes - ts)
        return "miss", ts + wait, strikes, reason
    return "miss", ts + wait, strikes + 1, reason


def waits(policy: Policy, strikes: Column, reason: Column, known: Column) -> Column:
    """The wait after a miss, in microseconds, by the misses before it."""
    number = lambda x: F.lit(x).cast("bigint")
    base = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in policy.base.items() for x in (F.lit(k), number(v)))), reason), number(policy.base[""]))
    climbed = base * F.pow(F.lit(2.0), F.least(F.greatest(strikes, F.lit(0)), F.lit(policy.most_doublings))).cast("bigint")
    capped = F.least(climbed, F.when(known, number(policy.longest)).otherwise(number(min(policy.longest, policy.longest_unknown))))
    fixed = [x for k, v in policy.fixed.items() for x in (F.lit(k), number(v[0]))]
    return F.coalesce(F.try_element_at(F.create_map(*fixed), reason), capped)


def replay(attempts: DataFrame, policy: Policy = PRICES) -> DataFrame:
    """(key, ts, action, until, strikes, reason) of all attempts (key, ts, reason, known, resumes): a fold over each key's history.

    Ties in time go by the other columns. A key's history is one array; for keys without end there is the stream.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ltz"))
    one = F.struct(micros("ts").alias("ts"), "reason", F.coalesce("known", F.lit(True)).alias("known"), micros("resumes").alias("resumes"))
    keys = attempts.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    number = lambda x: F.lit(x).cast("bigint")

    def wait(acc: Column, a: Column) -> Column:
        usual = waits(policy, acc["strikes"], a["reason"], a["known"])
        return F.when((a["reason"] == ALL_WAIT) & (a["resumes"] > a["ts"]), F.least(usual, a["resumes"] - a["ts"])).otherwise(usual)

    def step(acc: Column, a: Column) -> Column:
        skipped, answered = F.coalesce(a["ts"] < acc["until"], F.lit(False)), a["reason"].isNull()
        resets = a["reason"].isin(*(k for k, v in policy.fixed.items() if not v[1]), "")
        until = F.when(skipped, acc["until"]).when(~answered, a["ts"] + wait(acc, a))
        strikes = F.when(skipped, acc["strikes"]).when(answered | resets, F.lit(0)).when(a["reason"] == ALL_WAIT, acc["strikes"]).otherwise(acc["strikes"] + 1)
        reason = F.when(skipped, acc["reason"]).otherwise(a["reason"])
        action = F.when(skipped, "skipped").when(answered, "ok").otherwise("miss")
        row = F.struct(a["ts"].alias("ts"), action.alias("action"), until.alias("until"), strikes.alias("strikes"), reason.alias("reason"))
        return F.struct(until.alias("until"), strikes.alias("strikes"), reason.alias("reason"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(number(None).alias("until"), F.lit(0).alias("strikes"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<struct<ts:bigint,action:string,until:bigint,strikes:int,reason:string>>").alias("rows"))
    rows = keys.select("key", F.explode(F.aggregate("all", start, step, lambda acc: acc["rows"])).alias("r"))
    return rows.select("key", F.timestamp_micros("r.ts").alias("ts"), "r.action", F.timestamp_micros("r.until").alias("until"), "r.strikes", "r.reason")


class _Waits(StatefulProcessor):
    """until, strikes and reason of a key; a timer at the wait's end tells that the key is ready."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", STATE)

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        time = lambda x: None if x is None else pd.Timestamp(x, unit="us")
        return pd.DataFrame([(key[0], time(ts), action, time(until), strikes, reason) for ts, action, until, strikes, reason in rows], columns=["key", "ts", "action", "until", "strikes", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, strikes, held = self.state.get() if self.state.exists() else (None, 0, None)
        before, out = until, []
        micros = lambda x: None if pd.isna(x) else int(pd.Timestamp(x).value // 1000)
        text = lambda x: None if pd.isna(x) else x
        attempts = [(micros(ts), text(r), True if pd.isna(k) else bool(k), micros(m)) for pdf in rows for ts, r, k, m in zip(pdf["ts"], pdf["reason"], pdf["known"], pdf["resumes"])]
        for ts, reason, known, resumes in sorted(attempts, key=lambda a: tuple((x is not None, x) for x in a)):
            action, until, strikes, held = next_state(self.policy, until, int(strikes), held, ts, reason, known, resumes)
            out.append((ts, action, until, strikes, held))
        if before is not None and before != until:
            self.handle.deleteTimer(before // 1000)
        if until is None:
            self.state.clear()
        else:
            self.state.update((until, strikes, held))
            if until != before:
                self.handle.registerTimer(until // 1000)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The wait is over; strikes stay, so that the next miss waits longer."""
        until, strikes, reason = self.state.get()
        yield self._rows(key, [(until, "ready", until, strikes, reason)])

    def close(self) -> None:
        pass


def watch(attempts: DataFrame, policy: Policy = PRICES, late: str = "0 seconds") -> DataFrame:
    """The same rule on a stream of attempts; also a row "ready" for each wait that the watermark passes.

    State is a value for each key that waits or has strikes; a key that was answered has none. Needs the RocksDB state store.
    """
    timed = attempts.withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Waits(policy), STEP, "append", "EventTime")
