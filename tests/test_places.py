"""Rows of a contract stay together, so what groups by contract needs no exchange of texts; what is written between is small."""

import datetime

import pytest

from revverify import catalog
from revverify.operators import clauses, diff
from revverify.sources.corpus import contract_paragraphs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders with line items, a customer that is missing, and an order without items."""
    at, day = str(tmp_path_factory.mktemp("orders")), datetime.datetime(2024, 2, 29)
    spark.createDataFrame([(1, "Customer#1"), (2, "Customer#2")], "c_custkey long, c_name string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(k, k % 4, day, 1000.0 + k) for k in range(1, 41)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{at}/orders.parquet")
    items = [(k, n, 10 * k + n, n, float(n), day + datetime.timedelta(days=k + n)) for k in range(1, 40) for n in range(1, 4)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.fixture
def sorted_joins(spark):
    """Tables of a test are small; joins as of large ones."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _above_texts(df) -> int:
    """Exchanges of the plan above the step that makes the paragraphs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Generate posexplode")].count("Exchange ")


@pytest.mark.parametrize("name", ["mut_money_change", "mut_zh_date_change", "mut_authorized"])
def test_mutations_exchange_no_texts(spark, folder, sorted_joins, name):
    df = catalog.QUERIES[name](spark, folder)
    assert _above_texts(df) == 0
    assert df.count() == 40


def test_clauses_exchange_texts_once(spark, folder, sorted_joins):
    df = clauses.clauses_of(contract_paragraphs(spark, folder), "contract_id")
    assert _above_texts(df) == 1
    norms = {r["norm"] for r in clauses.clauses_of(contract_paragraphs(spark, folder, "zh"), "contract_id").where("label = '第三条'").select("norm").distinct().collect()}
    assert any(n.startswith("第三条 费用 每月费用为人民币1001元") for n in norms)


@pytest.mark.parametrize("name,language", [("mut_missing_edit", "en"), ("mut_zh_missing_edit", "zh")])
def test_missing_edit_gives_all_paragraphs(spark, folder, name, language):
    got = sorted(map(tuple, catalog.QUERIES[name](spark, folder).select("contract_id", "ordinal", "text").collect()))
    assert got == sorted(map(tuple, contract_paragraphs(spark, folder, language).collect())) and len(got) == 40 * 7 + 39 * 3 * 2


def test_pairs_carry_what_differs(spark):
    row = lambda n, label, path, fp: (1, n, label, path, "h" + label, fp * 32)
    schema = "pair_id long, clause_no int, label string, ancestor_path array<string>, heading string, fp string"
    before = spark.createDataFrame([row(1, "1", ["A"], "aa"), row(2, "2", ["A"], "bb"), row(3, "3", ["A"], "cc"), row(4, "4", [], "dd")], schema)
    after = spark.createDataFrame([row(1, "1", ["A"], "aa"), row(2, "2", ["a"], "ee"), row(3, "9", ["A"], "cc"), row(4, "5", [], "ff")], schema)
    pairs, rest_b, rest_a = diff.matched_clauses(before, after)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 1, 1, True, True), (1, 2, 2, False, False), (1, 3, 3, True, True)]
    assert [sorted(r["clause_no"] for r in d.collect()) for d in (rest_b, rest_a)] == [[3, 4], [3, 4]]
    assert sorted((r["kind"], r["b"] or 0, r["a"] or 0) for r in diff.clause_changes(before, after).collect()) == [("added", 0, 4), ("modified", 2, 2), ("removed", 4, 0)]
