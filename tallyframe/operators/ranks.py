"""Row numbers over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import kept


def numbered(rows: DataFrame, order: list[Column | str], name: str = "rank", by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds the row's number (from 1) in the order, over the table or in each group of by; total: a name for how many there are.

    Rows are dealt into ranges of the order and numbered inside each; a range starts after the sum of those before it,
    which is a sum over one row for each range (and group).
    """
    keys = [F.col(c) for c in by or []]
    dealt = rows.repartitionByRange(*keys, *order)
    dealt = kept(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    group = [*(by or []), "_part"]
    sizes = dealt.groupBy(*group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(by or [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by or []], F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*(by or []))).alias("_total"))
    same = F.col("_part") == F.col("_at")
    for c in by or []:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    out = dealt.withColumn("_inside", inside).join(sizes, same)
    return out.select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name), *([F.col("_total").alias(total)] if total else []))
