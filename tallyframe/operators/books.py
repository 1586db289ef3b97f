"""Work plans and the state of queues and logs; coverage; published returns; digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Published periods.
PUBLISHED = "m1 m3 m6 ytd y1 y2ann y3ann y5ann y10ann y15ann y20ann inceptionAnn".split()


def is_stale(status: Column, claimed: Column, before: Column) -> Column:
    """A running job whose claim is missing or older than a time."""
    return (status == "running") & (claimed.isNull() | (claimed < before))


def claim(queue: DataFrame, worker: str, now: Column, lease: Column, n: int) -> DataFrame:
    """The queue after a worker has claimed up to n jobs: queued ones and stale claims, oldest first.

    queue: (id, status, worker, claimed, queued_at). n is the size of one worker's batch.
    """
    free = queue.where((F.col("status") == "queued") | is_stale(F.col("status"), F.col("claimed"), lease))
    taken = free.orderBy("queued_at", "id").limit(n).select("id", F.lit(True).alias("_mine"))
    x = queue.join(taken, "id", "left")
    mine = F.coalesce("_mine", F.lit(False))
    return x.select(
        "id", F.when(mine, "running").otherwise(F.col("status")).alias("status"), F.when(mine, F.lit(worker)).otherwise(F.col("worker")).alias("worker"),
        F.when(mine, now).otherwise(F.col("claimed")).alias("claimed"), "queued_at",
    )


def release(queue: DataFrame, done: DataFrame, worker: str) -> DataFrame:
    """The queue after a worker reports: done: (id, ok). Only its own running jobs change: finished, or queued again."""
    x = queue.join(done, "id", "left")
    mine = (F.col("status") == "running") & (F.col("worker") == worker) & F.col("ok").isNotNull()
    again = mine & ~F.col("ok")
    return x.select(
        "id", F.when(mine & F.col("ok"), "done").when(again, "queued").otherwise(F.col("status")).alias("status"),
        F.when(again, F.lit(None)).otherwise(F.col("worker")).alias("worker"), F.when(again, F.lit(None)).otherwise(F.col("claimed")).alias("claimed"), "queued_at",
    )


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of parents that are written anew give way, all of them; those of other parents stay."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def newest(log: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n entries of each key of an append-only log."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def backfill_plan(rows: DataFrame, cap: int) -> DataFrame:
    """(symbol, plan): skipped when complete, cooling when resting, else fetch for the cap with the least support, deferred.

    rows: (symbol, complete, cooling, support, last_month); of equal support the longest without data first.
    """
    x = rows.where(F.col("symbol") != "")
    plan = F.when(F.coalesce("complete", F.lit(False)), "skipped").when(F.coalesce("cooling", F.lit(False)), "cooling")
    x = x.withColumn("plan", plan)
    order = [F.coalesce("support", F.lit(0)), F.coalesce("last_month", F.lit("")), F.col("symbol")]
    chosen = x.where("plan is null").orderBy(*order).limit(cap).select("symbol", F.lit("fetch").alias("_chosen"))
    return x.join(chosen, "symbol", "left").select("symbol", F.coalesce("plan", "_chosen", F.lit("deferred")).alias("plan"))


def look_through_coverage(holdings: DataFrame, by: list[str]) -> DataFrame:
    """How far breakdowns explain a book; holdings: (by..., instrument, type, weight, parts, as_of).

    A holding with a breakdown but no date, and a fund without a breakdown, are issues; the latter are listed.
    """
    through, fund = F.coalesce(F.col("parts") > 0, F.lit(False)), F.coalesce(F.col("type").isin("etf", "mutualfund"), F.lit(False))
    weight = F.coalesce("weight", F.lit(0.0))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("instrument"))))
    x = holdings.groupBy(*by).agg(
        F.sum(weight).alias("_all"), F.sum(F.when(through, weight).otherwise(0.0)).alias("_through"), F.count_if(~through).alias("single_bucket"),
        F.min(F.when(through, F.col("as_of"))).alias("oldest_as_of"), names(through & F.col("as_of").isNull()).alias("missing_as_of"), names(~through & fund).alias("missing_breakdown"),
    )
    return x.select(
        *by, F.when(F.col("_all") > 0, F.col("_through") / F.col("_all")).otherwise(0.0).alias("look_through"), "single_bucket", "oldest_as_of", "missing_as_of", "missing_breakdown",
        ((F.size("missing_as_of") > 0) | (F.size("missing_breakdown") > 0)).alias("issues"),
    )


def calendar_years(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """(key, year, ytd, value): both lists of years, the preferred one's where both have one; odd years and nulls go."""
    ranked = preferred.withColumn("_rank", F.lit(0)).unionByName(fallback.withColumn("_rank", F.lit(1)))
    x = ranked.where(F.col("year").between(1990, 2100) & F.col("value").isNotNull()).withColumn("ytd", F.coalesce("ytd", F.lit(False)))
    return x.groupBy("key", "year", "ytd").agg(F.min_by("value", "_rank").alias("value"))


def published_periods(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """(key, as_of, m1 ... inceptionAnn): the preferred source's figures, each filled from the other where it has none.

    A key neither of whose sources has a figure is left out.
    """
    a, b = preferred.alias("a"), fallback.alias("b")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    x = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(*[pick(c) for c in ("key", "as_of", *PUBLISHED)])
    return x.where(F.coalesce(*PUBLISHED).isNotNull())


def digest(trades: DataFrame, held: DataFrame, cap: int = 30) -> DataFrame:
    """The trades that a digest shows, in order: held tickers first, then newest, at most cap; overflow counts the rest.

    trades: (id, ticker, disclosed_date); held: (ticker), one row each.
    """
    x = trades.join(held.select("ticker", F.lit(True).alias("held")), "ticker", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    top = x.orderBy(F.desc("held"), F.col("disclosed_date").desc_nulls_last(), "id").limit(cap)
    top = top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("held"), F.col("disclosed_date").desc_nulls_last(), "id")).cast("long"))  # cap rows
    n = trades.agg(F.greatest(F.lit(0), F.count("*") - cap).alias("overflow"))
    return top.crossJoin(F.broadcast(n)).select("place", "id", "ticker", "held", "overflow")  # one row beside each


def merge_patch(current: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """(key, parts, as_of, status): a patch replaces a breakdown only with a date of its own.

    current: (key, parts, as_of); patch: (key, parts, as_of). No patch keeps what is there; an empty breakdown clears it and
    its date; parts without a date are refused.
    """
    x = current.alias("c").join(patch.withColumn("_p", F.lit(True)).alias("p"), key, "left")
    clears, refused = F.col("_p") & (F.size("p.parts") == 0), F.col("_p") & (F.size("p.parts") > 0) & F.col("p.as_of").isNull()
    status = F.when(F.col("_p").isNull() | F.col("p.parts").isNull(), "kept").when(clears, "cleared").when(refused, "refused").otherwise("replaced")
    x = x.withColumn("status", status)
    pick = lambda c: F.when(F.col("status") == "replaced", F.col(f"p.{c}")).when(F.col("status").isin("kept", "refused"), F.col(f"c.{c}")).alias(c)
    return x.select(key, pick("parts"), pick("as_of"), "status")


def append_quote(points: DataFrame, quotes: DataFrame) -> DataFrame:
    """(symbol, date, close): a series with the day's quote as its last point; quotes: (symbol, date, price).

    A quote of a stored day replaces its close; one that is not positive, or older than the last point, changes nothing.
    """
    last = points.groupBy("symbol").agg(F.max("date").alias("_last"))
    q = quotes.where(F.col("price") > 0).join(last, "symbol", "left").where(F.col("_last").isNull() | (F.col("date") >= F.col("_last")))
    q = q.select("symbol", "date", F.col("price").alias("close"))
    return points.join(q.select("symbol", "date"), ["symbol", "date"], "left_anti").select("symbol", "date", "close").unionByName(q)


def ingest_plan(index: DataFrame, stored: DataFrame, failed: DataFrame, cap: int) -> DataFrame:
    """(key, plan) of an index: stored, resting (failed too often), fetch for the newest of the rest up to cap, else later.

    index: (key, filed), stored: (key), failed: (key, strikes). What is left for later is the cursor of the next run.
    """
    x = index.join(stored.select("key", F.lit(True).alias("_stored")).distinct(), "key", "left").join(failed, "key", "left")
    x = x.withColumn("plan", F.when(F.col("_stored"), "stored").when(F.coalesce("strikes", F.lit(0)) >= 3, "resting"))
    chosen = x.where("plan is null").orderBy(F.col("filed").desc_nulls_last(), "key").limit(cap).select("key", F.lit("fetch").alias("_chosen"))
    return x.join(chosen, "key", "left").select("key", F.coalesce("plan", "_chosen", F.lit("later")).alias("plan"))


def revisit(rows: DataFrame, version: int, cap: int) -> DataFrame:
    """The rows that an older parser has read, oldest version first, at most cap: one bounded pass of a revisit."""
    return rows.where(F.coalesce("parser_version", F.lit(0)) < version).orderBy(F.coalesce("parser_version", F.lit(0)), F.col("filed").desc_nulls_last(), "key").limit(cap)


def patched(current: DataFrame, quotes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with each field from its quote where there is one, it differs and the field is not locked (array `locked`)."""
    q = quotes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    x = current.join(q, key, "left")
    new = lambda f: F.when(F.col(f"_{f}").isNotNull() & ~F.array_contains(F.coalesce("locked", F.array().cast("array<string>")), f), F.col(f"_{f}")).otherwise(F.col(f))
    return x.select(*[new(c).alias(c) if c in fields else F.col(c) for c in current.columns])


def longer_support(a: DataFrame, b: DataFrame) -> DataFrame:
    """(symbol, path, points): of two series of a symbol the one with more points; of equal ones the first; both (symbol, date)."""
    n = [x.groupBy("symbol").agg(F.count("*").alias(c)) for x, c in ((a, "_a"), (b, "_b"))]
    x = n[0].join(n[1], "symbol", "full_outer").fillna(0, ["_a", "_b"])
    return x.select("symbol", F.when(F.col("_a") >= F.col("_b"), "first").otherwise("second").alias("path"), F.greatest("_a", "_b").alias("points"))
