"""Digests that go out once, branches that commute, and names matched again in touched partitions only."""

import os
import tempfile
from datetime import date

import pytest

from tallyframe.operators import ledger

SINCE = date(2024, 1, 10)
TRADES = "id string, created date, disclosed date, pending boolean"


@pytest.fixture()
def trades(spark):
    rows = [(f"t{i}", date(2024, 1, i), date(2024, 2, 28 - i), i % 4 != 0) for i in range(5, 25)] + [("t20", date(2024, 1, 20), None, True)]
    return spark.createDataFrame(rows, TRADES)


def path():
    return f"{tempfile.mkdtemp(prefix='tallyframe-test-')}/sent"


def test_a_run_that_is_repeated_sends_nothing(trades):
    p, out = path(), []
    send = lambda rows: out.append(sorted(r.id for r in rows.collect())) or True
    assert ledger.send_digest(trades, p, "a", SINCE, send, shown=5) == ("sent", 1)
    assert ledger.send_digest(trades, p, "b", SINCE, send, shown=50) == ("sent", 1)
    assert ledger.send_digest(trades, p, "b", SINCE, send, shown=50) == ("nothing", 0)
    first, rest = map(set, out)
    assert len(first) == 5 and not first & rest and first | rest == {f"t{i}" for i in range(10, 25) if i % 4 or i == 20}  # t20 is pending in one of its rows
    assert first == {"t10", "t11", "t13", "t14", "t15"}  # the newest disclosed


def test_a_mark_that_fails_leaves_the_rows_due(trades):
    p, out, tries = path(), [], []

    def fail(ids, to):
        tries.append(1)
        raise OSError("the store is away")

    def late(ids, to):
        tries.append(1)
        if len(tries) % 3:
            raise OSError("not yet")
        ledger.append_ids(ids, to)

    send = lambda rows: out.append(rows.count()) or True
    assert ledger.send_digest(trades, p, "a", SINCE, send, write=fail) == ("unmarked", 3) and len(tries) == 3
    assert ledger.send_digest(trades, p, "a", SINCE, lambda rows: False) == ("refused", 0)
    assert ledger.send_digest(trades, p, "a", SINCE, send, write=late) == ("sent", 3)
    assert ledger.send_digest(trades, p, "b", SINCE, send) == ("nothing", 0)
    assert out[0] == out[1] and len(out) == 2  # at least once


def test_branches_without_a_conflict_commute(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "source string, value string")
    base = {"house": "1", "senate": "2", "oge": "3", "gone": "4", "null": None}
    ours, theirs = {**base, "house": "9", "new": "5", "null": "x"}, {**base, "senate": None}
    del theirs["gone"]
    read = lambda df: sorted(map(tuple, df.collect()), key=str)
    ab, ba = (read(ledger.merge_branches(make(base), make(x), make(y), ["source"], "value")) for x, y in ((ours, theirs), (theirs, ours)))
    assert ab == ba == sorted([("house", "9", False), ("senate", None, False), ("oge", "3", False), ("new", "5", False), ("null", "x", False)], key=str)
    both = read(ledger.merge_branches(make(base), make(ours), make({**base, "house": "8", "new": "5"}), ["source"], "value"))
    assert ("house", "8", True) in both and ("new", "5", False) in both
    assert read(ledger.merge_branches(make(base).where("false"), make(ours), make(ours).where("false"), ["source"], "value")) == sorted([(k, v, False) for k, v in ours.items()], key=str)


def test_slices_by_touched_source(spark):
    schema = "source string, part string, key string, value string, until date"
    current = [("house", "state", None, "h0", None), ("house", "wait", None, None, date(2024, 1, 1)), ("senate", "state", None, "s0", None), ("senate", "wait", None, None, date(2024, 1, 2)), ("oge", "state", None, "o0", None), ("oge", "document", "d1", None, date(2024, 3, 1)), ("oge", "document", "d2", None, date(2023, 1, 1))]
    local = [("house", "state", None, "h1", None), ("senate", "state", None, "s1", None), ("senate", "wait", None, None, date(2024, 5, 1)), ("oge", "state", None, "o1", None), ("oge", "document", "d1", None, date(2024, 6, 1)), ("oge", "document", "d3", None, date(2024, 6, 1))]
    got = ledger.merge_slices(spark.createDataFrame(current, schema), spark.createDataFrame(local, schema), {"house": "state", "senate": "wait"}, date(2024, 2, 1)).collect()
    assert {(r.source, r.part, r.key): (r.value, r.until) for r in got} == {
        ("house", "state", None): ("h1", None), ("senate", "state", None): ("s0", None), ("senate", "wait", None): (None, date(2024, 5, 1)), ("oge", "state", None): ("o0", None),
        ("oge", "document", "d1"): (None, date(2024, 6, 1)), ("oge", "document", "d3"): (None, date(2024, 6, 1)),
    }


def test_only_touched_partitions_are_written_again(spark):
    p, fetched = path(), date(2024, 3, 1)
    rows = [(1, "Omega Semiconductor Inc", None, None, None, None, None, "a"), (2, "Nobody Knows Co", None, None, None, None, None, "a"), (3, "Omega Semiconductor Inc", None, "filing", None, None, None, "b"), (4, "Omega", "OM", "filing", None, None, None, "b")]
    spark.createDataFrame(rows, "id int, asset string, ticker string, ticker_source string, confidence int, matched_at date, matched_by int, part string").write.partitionBy("part").parquet(p)
    files = lambda part: sorted(os.listdir(f"{p}/part={part}"))
    before = files("a"), files("b")
    catalog = spark.createDataFrame([("Omega Semiconductor Corp", "OMG", "NYSE")], "name string, ticker string, exchange string")
    assert ledger.rematch_table(spark, p, "part", fetched, catalog=catalog) == 2
    assert files("b") == before[1] and files("a") != before[0]
    got = {r.id: (r.ticker, r.ticker_source, r.matched_by) for r in spark.read.parquet(p).collect()}
    assert got == {1: ("OMG", "name_match", 3), 2: (None, None, 3), 3: (None, "filing", None), 4: ("OM", "filing", None)}
    assert ledger.rematch_table(spark, p, "part", fetched, catalog=catalog) == 0
    assert ledger.rematch_table(spark, p, "part", fetched, version=4, catalog=catalog) == 1  # a newer matcher looks at the other again
