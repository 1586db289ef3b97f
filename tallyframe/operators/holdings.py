"""Books of holdings: overlap, shared weight, pivots, look-through, rounding, funding and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(holdings: DataFrame, ranks: DataFrame) -> DataFrame:
    """(a, b, overlap, shared, adjacent) of all pairs of models by rank: the common weight of common instruments.

    holdings: (model_key, instrument, weight); the join is by instrument, so pairs come from shared holdings only.
    """
    h = holdings.join(ranks, "model_key").select("instrument", "model_key", "risk_rank", "weight")
    a, b = (h.select("instrument", F.col("model_key").alias(k), F.col("risk_rank").alias(f"r{k}"), F.col("weight").alias(f"w{k}")) for k in "ab")
    x = a.join(b, "instrument").where("ra < rb").groupBy("a", "b", "ra", "rb")
    x = x.agg(F.sum(F.least("wa", "wb")).alias("overlap"), F.count("*").alias("shared"))
    pairs = ranks.select(F.col("model_key").alias("a"), F.col("risk_rank").alias("ra")).join(ranks.select(F.col("model_key").alias("b"), F.col("risk_rank").alias("rb")), F.col("ra") < F.col("rb"))
    out = pairs.join(x.select("a", "b", "overlap", "shared"), ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("shared", F.lit(0)).alias("shared"), (F.col("rb") == F.col("ra") + 1).alias("adjacent"))


def shared_weight(holdings: DataFrame) -> DataFrame:
    """(model_key, unique_weight, shared_weight): weight in instruments that no other model holds, and in the rest."""
    n = F.count("*").over(Window.partitionBy("instrument"))
    x = holdings.withColumn("n", n).groupBy("model_key")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0))
    return x.agg(part(F.col("n") == 1).alias("unique_weight"), part(F.col("n") > 1).alias("shared_weight"))


def universe(holdings: DataFrame, models: Sequence[str]) -> DataFrame:
    """(instrument, one weight column per model, models, max_weight)."""
    p = holdings.groupBy("instrument").pivot("model_key", list(models)).agg(F.sum("weight"))
    n = sum((F.col(f"`{m}`").isNotNull().cast("long") for m in models), F.lit(0).cast("long"))
    return p.select("instrument", *[F.col(f"`{m}`") for m in models], n.alias("models"), F.greatest(*[F.col(f"`{m}`") for m in models]).alias("max_weight"))


def weighted_mean(value: Column, weight: Column) -> tuple[Column, Column]:
    """(mean over known values, share of weight that is known); weights of 0 or less do not count."""
    w = F.when(weight > 0, weight)
    known = F.when(value.isNotNull(), w)
    return F.try_divide(F.sum(value * known), F.sum(known)), F.try_divide(F.coalesce(F.sum(known), F.lit(0.0)), F.sum(w))


def look_through(holdings: DataFrame, breakdowns: DataFrame) -> DataFrame:
    """(model_key, label, weight): each holding's weight dealt out by its breakdown, normalised by its own sum.

    holdings: (model_key, instrument, weight, bucket); breakdowns: (instrument, label, share). A holding without a
    breakdown goes to its bucket, or to Unclassified.
    """
    parts = breakdowns.where("share > 0").withColumn("part", F.col("share") / F.sum("share").over(Window.partitionBy("instrument")))
    x = holdings.join(parts.select("instrument", "label", "part"), "instrument", "left")
    label = F.coalesce("label", "bucket", F.lit("Unclassified"))
    return x.groupBy("model_key", label.alias("label")).agg(F.sum(F.col("weight") * F.coalesce("part", F.lit(1.0))).alias("weight"))


def percent_slices(rows: DataFrame, by: Sequence[str], amount: str, order: str) -> DataFrame:
    """Adds pct: shares with one decimal that add up to 100.0; the first largest slice takes what rounding leaves."""
    w = Window.partitionBy(*by)
    x = rows.withColumn("_p", F.round(F.col(amount) * 1000 / F.sum(amount).over(w)).cast("long"))
    x = x.withColumns({"_left": F.lit(1000) - F.sum("_p").over(w), "_first": F.row_number().over(w.orderBy(F.desc(amount), order))})
    return x.withColumn("pct", (F.col("_p") + F.when(F.col("_first") == 1, F.col("_left")).otherwise(0)) / F.lit(10.0)).drop("_p", "_left", "_first")


def largest_remainder(rows: DataFrame, by: Sequence[str], weight: str, total: int, order: str) -> DataFrame:
    """Adds units: whole units in proportion to weight that add up to total; ties go to the first by order."""
    w = Window.partitionBy(*by)
    x = rows.withColumn("_x", F.col(weight) * total / F.sum(weight).over(w)).withColumn("_f", F.floor(F.round("_x", 9)).cast("long"))
    x = x.withColumns({"_short": F.lit(total) - F.sum("_f").over(w), "_k": F.row_number().over(w.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), order))})
    return x.withColumn("units", F.col("_f") + (F.col("_k") <= F.col("_short")).cast("long")).drop("_x", "_f", "_short", "_k")


#: Weights count in hundredths of a percent; a book within half a percent of the whole counts as whole.
WHOLE, NEARLY = 10_000, 50


def _units(weight: Column | float) -> Column:
    return F.round((F.lit(weight) if isinstance(weight, float) else weight) * WHOLE, 0).cast("long")


def fund_proportional(holdings: DataFrame, share: float, cash: Column) -> DataFrame:
    """(model_key, instrument, weight, can_add): the other holdings shrink by the room that the new one leaves, cash takes the
    residual; where that is negative, or there is no cash or nothing else, all shrink to the room in proportion.

    cash: whether a holding is cash. The new one keeps its share exactly; rounding lies with the largest remainders of the others.
    """
    w, room = Window.partitionBy("model_key"), 1 - share
    x = holdings.withColumns({"_cash": cash, "_all": F.sum("weight").over(w), "_other": F.sum(F.when(~cash, F.col("weight"))).over(w), "_held": F.sum(F.when(cash, F.col("weight"))).over(w), "_n": F.count_if(cash).over(w)})
    left = room - F.col("_other") * room
    split = F.when(F.col("_held") > 0, F.col("weight") / F.col("_held")).otherwise(1 / F.col("_n"))
    by_room = F.when(F.col("_cash"), split * left).otherwise(F.col("weight") * room)
    kept = (F.col("_n") > 0) & F.col("_other").isNotNull() & (left >= -1e-8)
    x = x.where("_all > 0").select("model_key", "instrument", F.when(kept, by_room).otherwise(F.col("weight") * room / F.col("_all")).alias("weight"))
    x = largest_remainder(x, ["model_key"], "weight", WHOLE - round(share * WHOLE), "instrument").select("model_key", "instrument", (F.col("units") / F.lit(float(WHOLE))).alias("weight"))
    new = holdings.select("model_key").distinct().select("model_key", F.lit("NEW").alias("instrument"), (_units(share) / F.lit(float(WHOLE))).alias("weight"))
    return x.unionByName(new).withColumn("can_add", F.lit(True))


def fund_from_cash(holdings: DataFrame, share: float, cash: Column) -> DataFrame:
    """(model_key, instrument, weight, can_add): the first cash holding, by instrument, gives the new one's share. A book that
    was nearly whole is made whole by it. Without cash, or with too little, nothing can be added.
    """
    w = Window.partitionBy("model_key")
    x = holdings.select("model_key", "instrument", "weight", cash.alias("_cash"), _units(F.col("weight")).alias("_u"))
    x = x.withColumns({"_giver": F.min(F.when(F.col("_cash"), F.col("instrument"))).over(w), "_total": F.sum("_u").over(w)})
    gives = F.coalesce(F.col("instrument") == F.col("_giver"), F.lit(False))
    x = x.withColumns({"_after": F.max(F.when(gives, F.col("_u") - _units(share))).over(w), "_others": F.sum(F.when(~gives, F.col("_u"))).over(w)})
    whole = WHOLE - F.coalesce("_others", F.lit(0)) - _units(share)
    given = F.when((F.col("_after") >= 0) & (F.abs(F.col("_total") - WHOLE) <= NEARLY) & (whole >= 0), whole).otherwise(F.col("_after"))
    can = F.coalesce(F.col("_after") >= 0, F.lit(False))
    weight = F.when(F.col("_giver").isNull(), F.col("weight")).when(gives, given / F.lit(float(WHOLE))).otherwise(F.col("_u") / F.lit(float(WHOLE)))
    new = x.groupBy("model_key").agg(F.first(can).alias("can_add")).select("model_key", F.lit("NEW").alias("instrument"), (_units(share) / F.lit(float(WHOLE))).alias("weight"), "can_add")
    return x.select("model_key", "instrument", weight.alias("weight"), can.alias("can_add")).unionByName(new)


def fund_manual(holdings: DataFrame, share: float) -> DataFrame:
    """(model_key, instrument, weight, can_add): the new holding beside the others, which stay; the sum may exceed the whole."""
    new = holdings.select("model_key").distinct().select("model_key", F.lit("NEW").alias("instrument"), (_units(share) / F.lit(float(WHOLE))).alias("weight"))
    return holdings.select("model_key", "instrument", "weight").unionByName(new).withColumn("can_add", F.lit(True))


def tie_slices(rows: DataFrame, by: Sequence[str], amount: str, named: int = 12, cap: int = 16) -> DataFrame:
    """(by..., slice, n, total): the largest items named, equal amounts never parted, the rest as Other.

    Groups of equal amounts are taken from the largest on until there are `named` slices. A group that fits into what is
    left of them, or into `cap` in all, is named item by item; a larger one becomes one slice of its own, and naming goes on.
    Every group makes a slice at least, so the first `named` groups decide; a fold over their sizes does.
    """
    groups = rows.groupBy(*by, amount).agg(F.count("*").alias("_size"))
    groups = groups.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(amount)))).where(F.col("_rank") <= named)
    sizes = groups.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_rank", F.col(amount).alias("_amount"), "_size"))).alias("_groups"))

    def step(acc: Column, g: Column) -> Column:
        whole = (g["_size"] <= named - acc["used"]) | (acc["used"] + g["_size"] <= cap)
        kind = F.when(acc["used"] >= named, "other").when(whole, "item").otherwise("group")
        used = acc["used"] + F.when(kind == "item", g["_size"]).when(kind == "group", 1).otherwise(0)
        return F.struct(used.cast("long").alias("used"), F.concat(acc["kinds"], F.array(F.struct(g["_amount"].alias("_amount"), kind.alias("_kind")))).alias("kinds"))

    kind = dict(rows.dtypes)[amount]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<_amount:{kind},_kind:string>>").alias("kinds"))
    kinds = sizes.select(*by, F.inline(F.aggregate("_groups", start, step, lambda acc: acc["kinds"])))
    x = rows.join(kinds.withColumnRenamed("_amount", amount), [*by, amount], "left")
    label = F.when(F.col("_kind") == "item", F.col("item")).when(F.col("_kind") == "group", F.concat(F.lit("Equal at "), F.col(amount).cast("string"))).otherwise("Other")
    return x.groupBy(*by, label.alias("slice")).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def same_holdings(a: DataFrame, b: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(key, same): whether two weight sets agree within eps; both (key, instrument, weight)."""
    x = a.withColumnRenamed("weight", "wa").join(b.withColumnRenamed("weight", "wb"), ["key", "instrument"], "full_outer")
    return x.groupBy("key").agg(F.every(F.abs(F.coalesce("wa", F.lit(0.0)) - F.coalesce("wb", F.lit(0.0))) <= eps).alias("same"))
