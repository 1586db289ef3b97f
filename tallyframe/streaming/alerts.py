"""Breach and recovery with hysteresis: one rule, replayed in batch and run as keyed state on a stream.

A series breaches at a drawdown of -threshold or lower, and recovers above -threshold + BAND (not at it); where that is
0 or more, it recovers at 0, as a drawdown is never above. A missing drawdown changes nothing. An episode opens once; a
breach after recovery opens a new one. Drawdowns are compared in percent, with a tolerance of EPS.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.kept import kept

BAND = 0.02
EPS = 1e-9
EVENTS = "key string, ts timestamp, drawdown double, action string, episode bigint"


def is_breached(drawdown: float | None, threshold: float) -> bool:
    return drawdown is not None and drawdown == drawdown and 100 * drawdown <= -100 * threshold + EPS


def is_recovered(drawdown: float | None, threshold: float) -> bool:
    if drawdown is None or drawdown != drawdown:
        return False
    recover = 100 * (BAND - threshold)
    return 100 * drawdown >= -EPS if recover >= 0 else 100 * drawdown > recover + EPS


def step(active: bool, episode: int, drawdown: float, threshold: float) -> tuple[bool, int, str]:
    """(active, episode, action) after one observation: open, update, recover or none."""
    if active and is_recovered(drawdown, threshold):
        return False, episode, "recover"
    if is_breached(drawdown, threshold):
        return (True, episode, "update") if active else (True, episode + 1, "open")
    return active, episode, "update" if active else "none"


def replay(events: DataFrame, threshold: float) -> DataFrame:
    """All actions of (key, ts, drawdown), in order, by windows alone.

    An observation sets the state (breach: active; above the band: calm) or keeps it, so the state is the last
    setting one, carried forward; episodes count the changes to active.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("ts")
    percent, recover = 100 * F.col("drawdown"), 100 * (BAND - threshold)
    breach, calm = percent <= -100 * threshold + EPS, percent >= -EPS if recover >= 0 else percent > recover + EPS
    x = events.withColumn("_set", F.when(breach, 1).when(calm, 0))
    x = x.withColumn("_on", F.coalesce(F.last("_set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    x = x.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(0)))
    action = F.when((F.col("_on") == 1) & (F.col("_was") == 0), "open").when((F.col("_on") == 0) & (F.col("_was") == 1), "recover").when(F.col("_on") == 1, "update").otherwise("none")
    x = x.withColumn("action", action)
    episode = F.sum((F.col("action") == "open").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.select("key", "ts", "drawdown", "action", episode.alias("episode"))


def monitor(events: DataFrame, threshold: float) -> DataFrame:
    """The same rule on a stream of (key, ts, drawdown): keyed state of two numbers, events of a batch in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, episode = state.get if state.exists else (False, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, drawdown in zip(rows["ts"], rows["drawdown"], strict=True):
            active, episode, action = step(bool(active), int(episode), drawdown, threshold)
            out.append((key[0], ts, drawdown, action, episode))
        state.update((bool(active), int(episode)))
        yield pd.DataFrame(out, columns=["key", "ts", "drawdown", "action", "episode"])

    return events.groupBy("key").applyInPandasWithState(run, EVENTS, "active boolean, episode bigint", "append", GroupStateTimeout.NoTimeout)


def check(prev: DataFrame, evaluated: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(key, status, action, opened): one check of all holdings against the alerts of before.

    prev: (key, status, opened); evaluated: (key, drawdown, at, stale), one row for each holding that has prices; held: (key).
    An active alert recovers, is kept, or is closed when its holding is gone; a breach opens one, unless the price is stale,
    which blocks it until there is a fresh one. Without a drawdown nothing changes.
    """
    x = prev.join(evaluated, "key", "full_outer").join(held.select("key", F.lit(True).alias("_held")).distinct(), "key", "left")
    percent, recover = 100 * F.col("drawdown"), 100 * (BAND - threshold)
    breach = F.coalesce(percent <= -100 * threshold + EPS, F.lit(False))
    calm = F.coalesce(percent >= -EPS if recover >= 0 else percent > recover + EPS, F.lit(False))
    active, gone = F.coalesce(F.col("status") == "active", F.lit(False)), F.col("_held").isNull()
    action = (
        F.when(gone & active, "close").when(gone, "none").when(active & calm, "recover").when(active, "update")
        .when(breach & F.coalesce("stale", F.lit(False)), "blocked").when(breach, "open").otherwise("none")
    )
    x = x.withColumn("action", action)
    status = F.when(F.col("action") == "close", "closed").when(F.col("action") == "recover", "recovered").when(F.col("action").isin("open", "update"), "active").otherwise(F.col("status"))
    return x.select("key", status.alias("status"), "action", F.when(F.col("action") == "open", F.col("at")).otherwise(F.col("opened")).alias("opened"))


def notify_once(batch: DataFrame, batch_id: int, sent_path: str) -> DataFrame:
    """The rows of a micro-batch that no other batch has sent, by id, recorded as sent; run inside foreachBatch.

    Ids are recorded with the batch's number, before anything is sent. A batch that is retried passes over its own records
    and returns the same rows again, so the sender has to take (batch_id, id) for one message; rows that another batch has
    recorded never come back.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates(["id"])
    record = rows.select("id", F.lit(batch_id).cast("long").alias("batch"))
    record.limit(0).write.mode("append").parquet(sent_path)  # so that there is a table to read
    sent = spark.read.schema(record.schema).parquet(sent_path)
    rows = kept(rows.join(sent.where(F.col("batch") != batch_id).select("id"), "id", "left_anti"), "unsent")
    rows.select("id", F.lit(batch_id).cast("long").alias("batch")).write.mode("append").parquet(sent_path)
    return rows


def event_windows(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts and sums per type and event-time window, late rows dropped after the watermark (an extension)."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
