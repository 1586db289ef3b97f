"""File readers on small files written here."""

import datetime as dt

from tallyframe.sources import files


def test_price_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,3,4.5,9\nbad,1,1,1,1,1\n2024-01-03,1,1,1,-1,1\n2024-01-04,1,1,1,N/D,1\n")
    assert [tuple(r) for r in files.price_csv(spark, str(tmp_path / "p.csv")).collect()] == [(dt.date(2024, 1, 2), 4.5)]


def test_store_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"models": [\n{"key": "a"}, {"key": "b"}]}')
    assert files.store_json(spark, str(tmp_path / "s.json"), "models array<struct<key:string>>").selectExpr("size(models) as n").first().n == 2


def test_member_index(spark, tmp_path):
    (tmp_path / "i.xml").write_text("<X><Member><Last>Roe</Last><First>Ann</First><FilingType>P</FilingType><FilingDate>3/9/2024</FilingDate><DocID>7</DocID></Member><Member><Last>Poe</Last><DocID>8</DocID></Member></X>")
    got = sorted(map(tuple, files.member_index(spark, str(tmp_path / "i.xml")).collect()))
    assert got == [("7", "Roe", "Ann", "P", dt.date(2024, 3, 9)), ("8", "Poe", None, None, None)]


def test_ocr_words(spark, tmp_path):
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "o.tsv").write_text(head + '5\t1\t1\t1\t1\t1\t10\t20\t5\t5\t91.5\t"quoted\n5\t1\t1\t1\t1\t2\t30\t20\t5\t5\t-1\tlow\n')
    assert [(r.x, r.text) for r in files.ocr_words(spark, str(tmp_path / "o.tsv")).collect()] == [(10.0, '"quoted')]
