"""Writes as plans: what an upsert, a merge or an append would leave, to be written by the caller in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after incoming rows replaced those with their keys; the last by `ord` wins within incoming."""
    names = [c for c in stored.columns]
    w = Window.partitionBy(*keys).orderBy(F.desc("_src"), F.desc("_ord"))
    both = stored.withColumns({"_src": F.lit(0), "_ord": F.lit(0).cast("long")}).unionByName(incoming.withColumnRenamed("ord", "_ord").withColumn("_src", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*names)


def changed(stored: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Incoming rows that would really change something (new key or a different value, nulls compared as values)."""
    s = stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there"))
    return incoming.join(s, keys, "left").where(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("_old"))).drop("_old", "_there")


def only_missing(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are not stored yet, the first by `ord` of each key."""
    first = incoming.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("_k = 1").drop("_k")
    return first.join(stored, keys, "left_anti")


def overlap_plan(stored: DataFrame, incoming: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """(keys..., added, overwritten, unchanged, kept, first, last) of a merge by date."""
    x = stored.withColumnRenamed(value, "_old").join(incoming.withColumnRenamed(value, "_new"), [*keys, date], "full_outer")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return x.groupBy(*keys).agg(
        F.count_if(~old & new).alias("added"), F.count_if(old & new & (F.col("_old") != F.col("_new"))).alias("overwritten"),
        F.count_if(old & new & (F.col("_old") == F.col("_new"))).alias("unchanged"), F.count_if(old & ~new).alias("kept"), F.min(date).alias("first"), F.max(date).alias("last"),
    )


def continue_numbers(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows numbered after the highest row_index stored for their key."""
    top = stored.groupBy(key).agg(F.max("row_index").alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return incoming.join(top, key, "left").withColumn("row_index", (F.coalesce("_top", F.lit(0)) + n).cast("long")).drop("_top")


def batch_status(payload: DataFrame, instruments: DataFrame) -> DataFrame:
    """Payload rows (id, date, value, ord) with a status: unknown, skipped, bad_date, bad_value, superseded or accepted."""
    x = payload.join(instruments.select("id", "type"), "id", "left").withColumn("d", F.try_to_date("date", "yyyy-MM-dd"))
    last = F.max("ord").over(Window.partitionBy("id", "date"))
    status = F.when(F.col("type").isNull(), "unknown").when((F.col("type") == "cash") | F.col("value").isNull(), "skipped").when(F.col("d").isNull(), "bad_date")
    return x.withColumn("status", status.when(F.col("value") <= 0, "bad_value").when(F.col("ord") < last, "superseded").otherwise("accepted")).drop("d", "type")


def seed_if_empty(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """The stored rows, or the seed where there is none: the seed's scan is skipped by a join with at most one row."""
    any_row = stored.limit(1).select(F.lit(True).alias("_any"))
    return stored.unionByName(seed.join(F.broadcast(any_row), F.lit(True), "left_anti"))


def append_versions(stored: DataFrame, incoming: DataFrame, eps: float = 1e-6) -> DataFrame:
    """The rows (key, effective_date, instrument, weight) that are appended: incoming versions of keys whose last stored version is another
    set of weights, or that have none. A version of a day that is stored, or before the last, is not appended.
    """
    last = stored.withColumn("_last", F.max("effective_date").over(Window.partitionBy("key"))).where("effective_date = _last")
    both = incoming.select("key", "instrument", F.col("weight").alias("_new"), F.col("effective_date").alias("_day")).join(last.select("key", "instrument", F.col("weight").alias("_old"), "_last"), ["key", "instrument"], "full_outer")
    differs = F.bool_or(F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))) > eps)
    keys = both.groupBy("key").agg(differs.alias("_differs"), F.max("_last").alias("_last"), F.max("_day").alias("_day")).where("_differs and _day is not null and (_last is null or _day > _last)")
    return incoming.join(keys.select("key"), "key", "left_semi")


def migrate_series(history: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points (symbol, date, close) that a one-time move of series adds, and the history (symbol, series) after it.

    history: series as an array of JSON objects. Of one day the first element counts whose date is a date and whose price, under
    close, price or nav, is a positive plain number; stored points stay. A series is cleared once its symbol has points. Run again, it adds nothing.
    """
    x = history.select(F.upper("symbol").alias("symbol"), F.posexplode("series").alias("ord", "e"))
    field = lambda name: F.get_json_object("e", f"$.{name}")
    raw, day = F.coalesce(field("close"), field("price"), field("nav")), field("date")
    x = x.select("symbol", "ord", F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(day, "yyyy-MM-dd")).alias("date"), F.when(raw.rlike(r"^[0-9]+([.][0-9]+)?$"), raw.try_cast("double")).alias("close"))
    first = x.where("date is not null and close > 0").groupBy("symbol", "date").agg(F.min_by("close", "ord").alias("close"))
    added = first.join(points.select("symbol", "date"), ["symbol", "date"], "left_anti")
    moved = points.select("symbol").unionByName(added.select("symbol")).distinct().select(F.col("symbol").alias("_s"), F.lit(True).alias("_moved"))
    after = history.join(moved, F.upper("symbol") == F.col("_s"), "left")
    return added, after.select("symbol", F.when(F.col("_moved"), F.array().cast("array<string>")).otherwise(F.col("series")).alias("series"))
