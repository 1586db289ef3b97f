"""The base tables and the domain views built on them.

Views are plans, not copies: a query that reads two columns of a view scans two columns of its tables.
Money is summed as DECIMAL where it is averaged later, so results do not depend on the order of rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Statutory amount ranges (label, lower, upper); the last one is open.
AMOUNT_RANGES = (
    ("$1,001 - $15,000", 1001, 15000),
    ("$15,001 - $50,000", 15001, 50000),
    ("$50,001 - $100,000", 50001, 100000),
    ("$100,001 - $250,000", 100001, 250000),
    ("$250,001 - $500,000", 250001, 500000),
    ("$500,001 - $1,000,000", 500001, 1000000),
    ("$1,000,001 - $5,000,000", 1000001, 5000000),
    ("$5,000,001 - $25,000,000", 5000001, 25000000),
    ("$25,000,001 - $50,000,000", 25000001, 50000000),
    ("Over $50,000,000", 50000001, None),
)
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def amount_label(amount: Column) -> Column:
    """The range that an amount falls into; null under the first one."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, low, high in AMOUNT_RANGES:
        out = out.when((amount >= low) if high is None else (amount >= low) & (amount <= high), label)
    return out


def bound_of(label: Column, which: int) -> Column:
    """Lower (1) or upper (2) bound of a range label; null where there is none."""
    pairs = [x for r in AMOUNT_RANGES if r[which] is not None for x in (F.lit(r[0]), F.lit(r[which]).cast("long"))]
    return F.try_element_at(F.create_map(*pairs), label)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)

    @cached_property
    def price_points(self) -> DataFrame:
        """symbol, date, close: a 20-observation mean of the daily mean order value of a nation."""
        o = self.orders.select("o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
        o = o.join(self.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        o = o.join(self.nation.select("n_nationkey", F.col("n_name").alias("symbol")), F.col("c_nationkey") == F.col("n_nationkey"))
        day = o.groupBy("symbol", "date").agg((F.sum("p").cast("double") / F.count("*")).alias("px"))
        w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-19, 0)
        mean = F.sum(F.col("px").cast("decimal(18,4)")).over(w).cast("double") / F.count("*").over(w)
        return day.select("symbol", "date", F.round(mean, 6).alias("close"))

    @cached_property
    def daily_points(self) -> DataFrame:
        """symbol, date, close: the last event value of a day."""
        e = self.events.select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), "ts", "event_id", "value")
        return e.groupBy("symbol", "date").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))

    @cached_property
    def models(self) -> DataFrame:
        m = self.customer.select(F.col("c_mktsegment").alias("model_key")).distinct()
        return m.select("model_key", F.row_number().over(Window.orderBy("model_key")).cast("long").alias("risk_rank"))

    @cached_property
    def version_holdings(self) -> DataFrame:
        """model_key, effective_date, instrument, weight: top ten nations by revenue of a segment and year, renormalised."""
        li = self.lineitem.select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("rev"))
        li = li.groupBy("l_orderkey").agg(F.sum("rev").alias("rev"))
        o = self.orders.select("o_orderkey", "o_custkey", F.trunc(F.to_date("o_orderdate"), "year").alias("effective_date"))
        c = self.customer.select("c_custkey", F.col("c_mktsegment").alias("model_key"), "c_nationkey")
        n = self.nation.select("n_nationkey", F.col("n_name").alias("instrument"))
        x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        x = x.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("model_key", "effective_date", "instrument").agg(F.sum("rev").alias("rev"))
        by = Window.partitionBy("model_key", "effective_date")
        x = x.withColumn("rk", F.row_number().over(by.orderBy(F.desc("rev"), "instrument"))).where("rk <= 10")
        weight = F.round(F.col("rev").cast("double") / F.sum("rev").over(by).cast("double"), 6)
        return x.select("model_key", "effective_date", "instrument", weight.alias("weight"))

    @cached_property
    def versions(self) -> DataFrame:
        return self.version_holdings.select("model_key", "effective_date").distinct()

    @cached_property
    def filing_heads(self) -> DataFrame:
        """What a filing has of its order, with the order's date in place of its own."""
        o = self.orders
        c = self.customer.select("c_custkey", "c_name", "c_nationkey")
        n = self.nation.select("n_nationkey", "n_regionkey")
        o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        office = F.when(F.col("n_regionkey") == 0, "house").when(F.col("n_regionkey") == 1, "senate").when(F.col("n_regionkey") == 2, "president")
        office = office.when(F.col("n_regionkey") == 3, "vice-president").otherwise("house")
        party = F.element_at(F.array(*map(F.lit, "DRI")), (F.col("n_nationkey") % 3 + 1).cast("int"))
        status = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "partial").otherwise("needs_manual_review")
        return o.select(
            F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("person_key"), F.col("c_name").alias("person_name"), office.alias("office"), party.alias("party"),
            F.when(F.col("o_orderpriority") == "5-LOW", "candidate").when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).otherwise("member").alias("filer_status"),
            F.to_date("o_orderdate").alias("filed_date"), status.alias("parse_status"),
        )

    @cached_property
    def filings(self) -> DataFrame:
        """One filing per order, filed on the order's date, or when the last line was shipped."""
        li = self.lineitem.groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("last_ship"))
        x = self.filing_heads.join(li, F.col("filing_id") == F.col("l_orderkey"), "left")
        return x.withColumn("filed_date", F.greatest("filed_date", "last_ship")).select(*self.filing_heads.columns)

    @cached_property
    def trades(self) -> DataFrame:
        """One trade per line. The filing's date comes from a window over the same lines, so they are read once."""
        return self._trades(self.lineitem, self.filing_heads)

    def trades_of(self, filings: DataFrame) -> DataFrame:
        """The trades of some filings (filing_id): other lines go before any is numbered or joined."""
        chosen = filings.select("filing_id")
        lines = self.lineitem.join(chosen.withColumnRenamed("filing_id", "l_orderkey"), "l_orderkey", "left_semi")
        return self._trades(lines, self.filing_heads.join(chosen, "filing_id", "left_semi"))

    def _trades(self, lines: DataFrame, heads: DataFrame) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        last_ship = F.max(F.to_date("l_shipdate")).over(Window.partitionBy("l_orderkey"))
        li = lines.withColumns({"row_index": F.row_number().over(order).cast("long"), "last_ship": last_ship})
        p = self.part.select("p_partkey", "p_brand", "p_type", "p_size")
        x = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(heads, F.col("l_orderkey") == F.col("filing_id"))
        x = x.withColumn("filed_date", F.greatest("filed_date", "last_ship"))
        amount = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity") / 2)
        kind = F.when(F.col("p_size") % 7 == 0, "option").when(F.col("p_size") % 5 == 0, "etf").when(F.col("p_size") % 11 == 0, "bond").otherwise("stock")
        return x.select(
            "filing_id", "row_index", "person_key", "person_name", "office", "party", "filer_status",
            F.when(F.col("p_size") > 5, F.concat_ws("-", "p_brand", "p_type")).alias("ticker"), kind.alias("asset_class"),
            F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("exchange").alias("tx_type"),
            F.least(F.to_date("l_shipdate"), F.col("filed_date")).alias("tx_date"), F.col("filed_date").alias("disclosed_date"), amount_label(amount).alias("amount_range"),
        )
