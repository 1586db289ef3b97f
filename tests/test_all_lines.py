"""Queries over all members of their tables: win22 over all orders, against brute force on keys past 2000; fin21 over all models."""

from collections import defaultdict

from tallyframe.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_lines_of_all_orders(spark):
    orders = defaultdict(lambda: defaultdict(list))
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        orders[r.l_orderkey][r.l_linenumber].append(r.l_partkey)
    want = {(k, n): " ".join(map(str, sorted(lines[at]))) for k, lines in orders.items() for n, at in enumerate(sorted(lines))}
    got = QUERIES["win22_text_lines"](spark, SF).collect()
    assert max(orders) > 2000 and len(got) == len(want) and {(r.doc, r.line): r.text for r in got} == want


def test_common_window_of_all_models(spark, sf_dir):
    models = {r.c_mktsegment for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment").distinct().collect()}
    got = QUERIES["fin21_model_window_risk"](spark, sf_dir).collect()
    assert {r.model_key for r in got} == models and len({r.n for r in got}) == 1
