"""Lines of word boxes against a plain loop, and schedules whose headers move."""

import random
from collections import defaultdict

from tallyframe.operators import boxes

WORDS = "doc int, page int, text string, confidence int, x double, y double, x1 double, y1 double"


def plain_lines(words):
    """words: (text, x, y, x1, y1) of one page; texts of its lines by a loop."""
    words = sorted(((y + y1) / 2, x, t, max(1.0, y1 - y)) for t, x, y, _, y1 in words if t.strip())
    gap = max(8.0, sorted(w[3] for w in words)[len(words) // 2] * 0.55)
    lines = []
    for cy, x, t, _ in words:
        if lines and abs(cy - lines[-1][0]) <= gap:
            old, row = lines[-1]
            lines[-1] = ((old * len(row) + cy) / (len(row) + 1), [*row, (x, cy, t)])
        else:
            lines.append((cy, [(x, cy, t)]))
    return [" ".join(t for _, _, t in sorted(row)) for _, row in lines]


def test_running_means_equal_a_plain_loop(spark):
    r, rows, want = random.Random(4), [], {}
    for page in range(12):
        words = []
        for line in range(9):
            slope = r.uniform(-0.03, 0.03)
            for k in range(r.randrange(1, 12)):
                x, high = 40.0 * k + r.random(), r.uniform(6, 16)
                y = 15.0 * line + slope * x + r.uniform(-3, 3)
                words.append((f"w{line}_{k}" if r.random() < 0.95 else " ", x, y, x + 30, y + high))
        rows += [(1, page, t, 90, x, y, x1, y1) for t, x, y, x1, y1 in words]
        want[page] = plain_lines(words)
    got = defaultdict(dict)
    for g in boxes.scan_lines(spark.createDataFrame(rows, WORDS)).collect():
        got[g.page][g.line] = g.text
    assert {p: [ls[i] for i in sorted(ls)] for p, ls in got.items()} == want


def test_a_chain_of_gaps_would_join_what_means_keep_apart(spark):
    rows = [(1, 1, f"a{k}", 90, 10.0 * k, 3.0 * k, 10.0 * k + 9, 3.0 * k + 10) for k in range(12)]  # 33 down in steps of 3
    got = [r.text for r in boxes.scan_lines(spark.createDataFrame(rows, WORDS)).orderBy("line").collect()]
    assert got == plain_lines([(t, x, y, x1, y1) for _, _, t, _, x, y, x1, y1 in rows]) and 1 < len(got) < 12
    assert boxes.scan_lines(spark.createDataFrame([], WORDS)).count() == 0


def report(spark, items):
    df = spark.createDataFrame([(d, p, float(x), float(y), t) for d, p, x, y, t in items], "doc int, page int, x double, y double, text string")
    holdings, status = boxes.schedule_holdings(df)
    return sorted((r.doc, r.nth, r.asset, r.owner, r.label) for r in holdings.collect()), {r.doc: (r.status, r.none_disclosed, r.holdings, r.excluded, r.unreadable) for r in status.collect()}


HEAD = lambda d, p, y, a, v: [(d, p, a, y, "Asset"), (d, p, v, y, "Value of Asset")]


def test_columns_follow_the_last_header_over_pages(spark):
    """The second report's pages have headers in other places, and its last page has none, so the last one's columns hold there."""
    small, large = "$1,001 - $15,000", "$15,001 - $50,000"
    items = [*HEAD(1, 1, 5, 10, 300), (1, 1, 12, 20, "One [ST]"), (1, 1, 301, 20, small), (1, 2, 12, 20, "Two [ST]"), (1, 2, 301, 22, large)]
    items += [*HEAD(2, 1, 5, 10, 200), (2, 1, 12, 20, "One [ST]"), (2, 1, 201, 20, small), *HEAD(2, 2, 5, 400, 700), (2, 2, 402, 20, "Two [ST]"), (2, 2, 705, 20, large), (2, 3, 402, 20, "Three [ST]"), (2, 3, 705, 20, small)]
    got, status = report(spark, items)
    assert got == [(1, 1, "One", "self", small), (1, 2, "Two", "self", large), (2, 1, "One", "self", small), (2, 2, "Two", "self", large), (2, 3, "Three", "self", small)]
    assert status == {1: ("parsed", False, 2, 0, 0), 2: ("parsed", False, 3, 0, 0)}


def test_titles_end_a_schedule_and_values_wrap(spark):
    items = [(1, 1, 10, 2, "S A: Assets"), *HEAD(1, 1, 10, 10, 300), (1, 1, 10, 20, "Alpha [ST]"), (1, 1, 300, 20, "$1,001 -")]
    items += [(1, 1, 10, 30, "S C: Earned income"), (1, 1, 300, 40, "$15,000")]  # the value's end stands in another schedule
    items += [(2, 1, 10, 2, "S A: Assets"), *HEAD(2, 1, 10, 10, 300), (2, 1, 10, 20, "Beta"), (2, 1, 300, 20, "$1,001 -"), (2, 1, 10, 28, "Corp [ST]"), (2, 1, 300, 40, "$15,000"), (2, 1, 10, 50, "[OL]"), (2, 1, 10, 60, "of no value")]
    items += [(3, 1, 10, 2, "S B: Transactions"), (3, 1, 10, 20, "Before [ST]"), (3, 1, 300, 20, "$1,001 - $15,000"), (3, 2, 10, 2, "S A: Assets"), (3, 2, 10, 10, "Gamma Trust SP"), (3, 2, 275, 10, "Undetermined")]
    got, status = report(spark, items)
    assert got == [(2, 1, "Beta Corp of no value", "self", "$1,001 - $15,000"), (3, 1, "Gamma Trust", "spouse", "Undetermined")]
    assert status == {1: ("needs_manual_review", False, 0, 0, 1), 2: ("parsed", False, 1, 0, 0), 3: ("parsed", False, 1, 0, 0)}
    assert report(spark, items[:0]) == ([], {})
