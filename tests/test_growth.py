"""What grows with the tables: work is dealt over all cores, done once, and never handed to the driver or to one pair of a kind."""

import contextlib
import datetime as dt
import io

import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.functions.text import loose_date
from tallyframe.operators import extract, names, sheets
from tallyframe.plans import funds, pages
from tallyframe.plans.catalog import QUERIES
from tallyframe.sources import files
from tallyframe.sources.tables import Tables


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rows_of_one_file_are_dealt_over_all_cores(spark, sf_dir):
    t = Tables(spark, sf_dir)
    for made in (pages.asset_pages(t), funds.sheets(t), pages.scans(t), pages.reports(t)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_previews_send_no_table_to_the_driver(spark, sf_dir):
    assert "Broadcast" not in plan(QUERIES["rec10_upload_previews"](spark, sf_dir))


def test_pages_are_parsed_once(spark):
    docs = spark.createDataFrame([(1, "<table><tr><th>Asset</th><th>Owner</th><th>Value</th></tr><tr><td>A</td><td>Self</td><td>$1,001 - $15,000</td></tr></table>"), (2, "")], "id long, html string")
    rows, status = extract.annual_html_holdings(extract.html_cells(docs, "id", "html"))
    assert "MapInArrow" not in plan(rows) + plan(status)
    assert [(r.id, r.asset, r.low) for r in rows.collect()] == [(1, "A", 1001)] and [(r.id, r.status) for r in status.collect()] == [(1, "parsed")]


def test_cells_field_by_field():
    rows = ([("a b", ["a", "b"], None, ""), ("", [], "x", "s")], [("c", ["c"], None, "")])
    want = [[dict(zip(extract.CELL.names, c)) for c in row] for row in rows]
    got = extract.cell_lists(rows)
    assert got.type == pa.list_(extract.CELL) and got.to_pylist() == want


def test_dates_by_their_marks_are_those_of_all_forms(spark):
    texts = "2024-03-09|3/9/2024|Mar 9, 2024|March 9, 2024|May 1, 2024|9 Mar 2024|20240309| 2024-3-9|13/40/2024|Sept 9, 2024|Mar 9 2024|1989-01-01|2101-01-01|x|2024/03/09|9 March 2024|2024||Mar  9, 2024|march 9, 2024|a, b/c".split("|")
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "x string")
    forms = ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd", "MMMM d, yyyy")
    d = F.coalesce(*[F.try_to_date(F.trim("x"), f) for f in forms])
    got = df.select("x", loose_date(F.col("x")).alias("got"), F.when(F.year(d).between(1990, 2100), d).alias("want")).collect()
    assert all(r.got == r.want for r in got) and sum(r.got == dt.date(2024, 3, 9) for r in got) >= 5


def test_names_that_share_only_their_end_pair_nothing(spark, monkeypatch):
    pairs = []
    inner = names.shared_pieces
    monkeypatch.setattr(names, "shared_pieces", lambda *a: pairs.append(inner(*a)) or pairs[-1])
    stem = lambda i, end: f"a{i:05d}wordword {end}"
    stems = spark.createDataFrame([(stem(i, "internationa holdings"), "") for i in range(60)] + [("3m internationa holdings", "")], "stem string, share_class string")
    listed = spark.createDataFrame([(stem(i, "international holdings"), "", f"T{i}", "stock") for i in range(60)] + [("3m international holdings", "", "M", "stock")], "stem string, share_class string, ticker string, class string")
    got = {r.stem: r.ticker for r in names.close_names(stems, listed).collect()}
    assert got == {**{stem(i, "internationa holdings"): f"T{i}" for i in range(60)}, "3m internationa holdings": "M"}
    assert pairs[0].count() == 61


def test_pages_in_lines_and_in_folders(spark, tmp_path):
    page = '"recordsFiltered":1,"data":[{"docDate":"2024-01-02T00","title":"t","type":"k","name":"n"}]}'
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(f'{{"start":{s},{page}' for s in (0, 100)))
    for s in (0, 100):
        (tmp_path / "folders" / f"start={s}").mkdir(parents=True)
        (tmp_path / "folders" / f"start={s}" / "a.json").write_text("{" + page)
    want = [(s, 0, "2024-01-02T00", "t", "k", "n") for s in (0, 100)]
    for kind in ("lines", "folders"):
        assert sorted(map(tuple, files.paged_json(spark, str(tmp_path / kind)).collect())) == want


def test_days_given_twice_with_two_prices(spark):
    docs = spark.createDataFrame([(1, "Date  Close\n2021-01-04  1.5\n2021-01-04  1.5\n2021-01-05  2\n2021-01-05  3")], "id long, text string")
    assert sheets.price_sheet(docs)[2].first().unlike == 1


def test_names_that_share_all_but_a_number_pair_only_near_ones(spark, monkeypatch):
    """Every name begins and ends alike, so pieces pair all with all; edits are put in, taken out and changed at all places."""
    stem = lambda i: f"supplier {i * 7919 % 10**6:09d} holdings"
    listed = [stem(i) for i in range(150)]
    wanted = [listed[0][:k] + c + listed[0][k + d :] for k in range(len(listed[0])) for c in ("", "x", "l") for d in (0, 1)] + [stem(i)[:-1] + "z" for i in range(1, 150)] + [listed[0][1:-1]]
    stems = spark.createDataFrame([(s, "h") for s in set(wanted)], "stem string, head string")
    others = spark.createDataFrame([(s, "h", str(i)) for i, s in enumerate(listed)], "other string, head string, ticker string")
    like = stems.crossJoin(others.select("other")).where("levenshtein(stem, other) <= floor(0.06 * greatest(length(stem), length(other)) + 1e-9)")
    pairs = lambda x: {(r.stem, r.other) for r in x.select("stem", "other").collect()}
    want = pairs(like)
    for most in (0, 8):  # pieces stand for nothing, or pair a name with 8 at most
        monkeypatch.setattr(names, "HEAVY", most)
        got = pairs(names.shared_pieces(stems, others, 0.94))
        assert want and (got == want if most == 0 else got >= want and len(got) < len(want) + 8 * len(set(wanted)))


def test_only_lines_of_current_filings_are_numbered(spark, sf_dir):
    """Lines of all filings were numbered and joined once, and for the classes twice."""
    for name in ("fin30_presented_classes", "fin30_presented_totals"):
        lines = plan(QUERIES[name](spark, sf_dir)).splitlines()
        numbers = [i for i, line in enumerate(lines) if "Window [row_number()" in line]
        assert len(numbers) == 1 and any("LeftSemi" in line for line in lines[numbers[0] :])
    t = Tables(spark, sf_dir)
    some = t.filings.where("filing_id % 3 = 0")
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(t.trades_of(some)) == rows(t.trades.where("filing_id % 3 = 0"))


def test_names_are_joined_without_a_broadcast(spark, sf_dir, monkeypatch):
    """Sizes of a few columns were guessed from compressed files, so tables of all names went through the driver."""
    plans = []
    inner = names.kept
    monkeypatch.setattr(names, "kept", lambda df, name: plans.append((name, plan(df))) or inner(df, name))
    for name in ("rec02_holding_tickers", "fin32_match_stages"):
        plans.append((name, plan(QUERIES[name](spark, sf_dir))))
        assert {"stems", "catalog", "forms", "found", "heavy", name} <= {n for n, _ in plans} and [n for n, p in plans if "Broadcast" in p] == []
        assert sum(p.count("SortMergeJoin") for _, p in plans) >= 8
        plans.clear()
