"""Readers for the file formats that the domain uses, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def price_csv(spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, close) of daily price files: a header with Date and, fifth, Close; by: columns that the folders' names hold."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*by, F.try_to_date(raw.columns[0], "yyyy-MM-dd").alias("date"), F.col(raw.columns[4]).try_cast("double").alias("close")).where("date is not null and close > 0")


PAGE = "start int, recordsFiltered bigint, data array<struct<docDate:string,title:string,type:string,name:string>>"


def paged_json(spark: SparkSession, path: str) -> DataFrame:
    """(start, row, docDate, title, type, name) of an answer in pages: a JSON document each, in folders start=0, start=100 ..., or lines that hold
    their start, many to a file.
    """
    pages = spark.read.schema(PAGE).json(path)
    return pages.select("start", F.posexplode("data").alias("row", "r")).select("start", "row", "r.*")


def page_order(rows: DataFrame) -> DataFrame:
    """(direction, unordered): whether pages (start, docDate) go up or down in time by their dates' spans, and the pages that do not fit.

    A direction is that of most neighbours; a page without dates fits anywhere, and one page alone has no direction.
    """
    day = F.left("docDate", F.lit(10))
    spans = rows.where(day.rlike(r"^\d{4}-\d\d-\d\d$")).groupBy("start").agg(F.min(day).alias("old"), F.max(day).alias("new"))
    w = Window.partitionBy().orderBy("start")  # a row for each page
    x = spans.withColumns({"up": F.col("old") >= F.lag("new").over(w), "down": F.col("new") <= F.lag("old").over(w)})
    ups, downs = F.count_if(F.col("up") & ~F.col("down")), F.count_if(F.col("down") & ~F.col("up"))
    both = x.agg(ups.alias("u"), downs.alias("d"), F.array_sort(F.collect_list(F.when(~F.col("up"), F.col("start")))).alias("not_up"), F.array_sort(F.collect_list(F.when(~F.col("down"), F.col("start")))).alias("not_down"))
    direction = F.when(F.col("u") > F.col("d"), "ascending").when(F.col("d") > F.col("u"), "descending")
    return both.select(direction.alias("direction"), F.when(direction == "ascending", F.col("not_up")).when(direction == "descending", F.col("not_down")).otherwise(F.array().cast("array<int>")).alias("unordered"))


def store_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store kept as one JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def member_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, last, first, kind, filed_date) of an XML filing index."""
    raw = spark.read.format("xml").option("rowTag", "Member").schema("Last string, First string, FilingType string, FilingDate string, DocID string").load(path)
    return raw.select(F.col("DocID").alias("doc_id"), F.col("Last").alias("last"), F.col("First").alias("first"), F.col("FilingType").alias("kind"), F.try_to_date("FilingDate", "M/d/yyyy").alias("filed_date"))


def ocr_words(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """(page, x, y, confidence, text) of recognised words."""
    schema = "level int, page int, block int, par int, line int, word int, x double, y double, w double, h double, confidence double, text string"
    raw = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return raw.where((F.col("confidence") >= least) & (F.trim("text") != "")).select("page", "x", "y", "confidence", "text")


def unnest_series(series: Column) -> Column:
    """(pos, point) generator of a JSON series whose value goes by one of several names."""
    return F.posexplode(F.from_json(series, "array<struct<date:string,close:double,price:double,nav:double,value:double>>"))


def chart_points(chart: Column) -> Column:
    """(ts, value) of parallel arrays in a chart document; the adjusted close goes before the close."""
    d = F.from_json(chart, "struct<timestamp:array<bigint>,close:array<double>,adjclose:array<double>>")
    zipped = F.arrays_zip(d["timestamp"].alias("ts"), d["close"].alias("close"), d["adjclose"].alias("adj"))
    return F.transform(zipped, lambda z: F.struct(F.timestamp_seconds(z["ts"]).alias("ts"), F.coalesce(z["adj"], z["close"]).alias("value")))


def first_source(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Of rows from several providers, the best ranked one per key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), rank).alias("r")).select(*keys, "r.*")
