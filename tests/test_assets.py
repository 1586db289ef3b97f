"""Names of assets step by step, and readers of texts on rows without any."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import assets
from tallyframe.operators import boxes, extract, fundsheets, names, sheets


def test_steps_of_a_name(spark):
    wanted = {
        "Alpha inc corp co ltd llc plc nv sa ag": ("alpha inc", ""),  # eight words at most go
        "The Walt Disney Co.": ("walt disney", ""), "AT&T Inc": ("at and t", ""), "Moody’s Corp": ("moodys", ""), "Inc": ("inc", ""), "Nestlé S A Sponsored ADR": ("nestle", ""),
        "T-Mobile U S Inc": ("t mobile us", ""), "Berkshire Hathaway Cl B": ("berkshire hathaway", "b"), "Core Corp": ("core", ""), "Alpha Series Class C Common Stock": ("alpha", "c"), "Beta and Co": ("beta", ""), "": ("", ""),
    }
    df = spark.createDataFrame(list(wanted), "string").select("value", assets.asset_name(F.col("value")).alias("n"))
    assert {r.value: (r.n.stem, r.n.share_class) for r in df.collect()} == wanted
    none = spark.createDataFrame([(None,)], "s string").select(assets.asset_name(F.col("s")).alias("n"), assets.never_matched(F.col("s")).alias("b")).first()
    assert none.n.stem == "" and none.b is None


def test_two_tickers_of_one_name_leave_it_open(spark):
    cat = spark.createDataFrame([("Alpha Industries", "ALP", "NYSE"), ("Alpha Inds", "ALQ", "NYSE"), ("Beta Mfg", "BET", "OTC"), ("Beta Manufacturing Inc", "BTM", "Cboe"), (None, "X", None), ("Gamma", None, "NYSE")], "name string, ticker string, exchange string")
    index, stems = names.catalog_index(cat, names.class_listings(cat.selectExpr("name", "'' as share_class", "ticker").where("false")))
    assert [(r.stem, r.share_class, r.ticker) for r in index.collect()] == [("beta manufacturing", "", "BTM")]
    assert {r.stem: sorted(r.known) for r in stems.collect()} == {"alpha industries": ["ALP", "ALQ"], "beta manufacturing": ["BTM"]}
    wanted = spark.createDataFrame([(1, "Beta Mfg Co"), (2, None), (2, "Alpha Industries")], "id int, name string")
    assert sorted((r.id, r.ticker or "") for r in names.match_names(wanted, cat).collect()) == [(1, "BTM"), (2, ""), (2, "")]
    assert names.match_names(wanted.where("false"), cat).count() == 0 and names.match_names(wanted, cat.where("false")).count() == 3


@pytest.mark.parametrize("read", [lambda d: fundsheets.fund_sheets(d), lambda d: sheets.price_sheet(d)[2], lambda d: extract.house_trades(d)[1]])
def test_texts_that_hold_nothing(spark, read):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "no table\n\n$ ,;\tDate Close")], "id int, text string")
    assert sorted(r.id for r in read(docs).collect()) == [1, 2, 3] and read(docs.where("false")).count() == 0


def test_pages_that_hold_nothing(spark):
    empty = spark.createDataFrame([(1, 1, 5.0, 5.0, None), (1, 1, 5.0, 9.0, "")], "doc int, page int, x double, y double, text string")
    for read in (boxes.schedule_holdings, boxes.part_holdings):
        rows, status = read(empty)
        assert rows.count() == 0 and [(r.doc, r.status) for r in status.collect()] == [(1, "pending_ocr")]
    cells = extract.html_cells(spark.createDataFrame([(2**60 + 1, "<table><tr><td>x<b>y</b>"), (None, None), (None, "<td>z</td>")], "id long, html string").coalesce(1), "id", "html")
    assert [(r.id, r.cells) for r in cells.collect()] == []  # a cell that is never closed is none
    kept = extract.html_tables(spark.createDataFrame([(2**60 + 1, "<table><tr><td>x</td></tr></table>"), (None, "<table><tr><td>y</td></tr></table>")], "id long, html string").coalesce(1), "id", "html")
    assert [(r.id, r.cells) for r in kept.collect()] == [(2**60 + 1, ["x"]), (None, ["y"])]
