"""Findings of round 3: queries against their SQL on folders made for them, and what their plans hold."""

import datetime
import difflib
import random
from collections import Counter

import duckdb
import pytest

from revverify import catalog, queries_policy
from revverify.functions import text
from revverify.operators import clauses, entities, links, rules
from revverify.sources.corpus import contract_paragraphs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders whose items are equal but for consecutive days, so a date a day later makes two paragraphs equal."""
    at, day = str(tmp_path_factory.mktemp("orders")), datetime.datetime(2024, 3, 4)
    spark.createDataFrame([(k, f"Customer#{k}") for k in range(4)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(k, k % 4, day, 1000.0 + k) for k in range(1, 81)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(f"{at}/orders.parquet")
    items = [(k, n, n, n, 5.0, day + datetime.timedelta(days=n)) for k in range(1, 81) for n in range(1, 6)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return at


def both(spark, folder, name) -> tuple[Counter, Counter]:
    d = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return Counter(map(tuple, catalog.QUERIES[name](spark, folder).collect())), Counter(d.sql(catalog.ORACLES[name]).fetchall())


def test_block_differences_of_crossing_matches(spark, folder):
    got, want = both(spark, folder, "set_block_diff")
    assert got == want
    assert max(Counter(r[0] for r in got.elements()).values()) > 2  # some matches cross and are taken apart


def test_cross_digests_send_no_table_whole(spark, folder):
    df = catalog.QUERIES["rul_cross_digests"](spark, folder)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    got, want = both(spark, folder, "rul_cross_digests")
    assert got == want and len(got) > 0


def test_trees_fingerprints_and_clauses_without_ids_exchange_no_texts(spark, folder):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of a test are small; joins as of large ones
    try:
        p = contract_paragraphs(spark, folder)
        made = [catalog.QUERIES["win_clause_tree"](spark, folder), clauses.clauses_of(p, "contract_id", ids=False), clauses.labelled_fingerprints(p, "Article II", "contract_id")]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [plan[: plan.index("Generate posexplode")].count("Exchange ") for plan in plans] == [0, 0, 0]
    whole = {(r["contract_id"], r["clause_no"]): (r["label"], r["fp"], r["parent_no"]) for r in clauses.clauses_of(p, "contract_id").collect()}
    assert {(r["contract_id"], r["clause_no"]): (r["label"], r["fp"], r["parent_no"]) for r in made[1].collect()} == whole
    assert sorted(map(tuple, made[2].collect())) == sorted((k, v[1]) for (k, _), v in whole.items() if v[0] == "Article II")


def test_contracts_are_dealt_over_all_cores(spark):
    """one small file of orders was one task, which scanned all paragraphs."""
    p = contract_paragraphs(spark, "/root/testdata/sf0.001")
    assert p.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_entities_of_texts_with_the_scan_own_signs(spark):
    """matches are marked with two control signs; a text that holds them keeps its places and values."""
    rows = spark.createDataFrame([(1, "\x01USD 5\x02; pay in 30 days. 4.1 Item 77")], "id long, text string")
    e = {(r.kind, r.pos, r.text, r.value) for r in entities.extract(rows, ["id"]).collect()}
    assert e == {("currency", 1, "USD", "USD"), ("money", 1, "USD 5", "5"), ("duration", 16, "30 days", "30 day")}


def test_ratio_takes_the_blocks_of_difflib():
    """the ratio of long lines took most of the time; its blocks and value stay those of difflib."""
    rnd = random.Random(15)
    for turn in range(3000):
        signs = ("ab", "abcd", "abcdefgh ")[turn % 3]
        a = "".join(rnd.choice(signs) for _ in range(rnd.randrange(40)))
        b = list(a) if turn % 2 else [rnd.choice(signs) for _ in range(rnd.randrange(40))]
        for _ in range(rnd.randrange(4)):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(["x", "", "üy"])
        b = "".join(b)
        want = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert text.matching_ratio(a, b) == want.ratio()
        assert text._longest_common(a, b) == tuple(want.find_longest_match(0, len(a), 0, len(b)))
        assert text.matching_ratio(a, b, 0.9) in ((want.ratio(),) if want.ratio() >= 0.9 else (0.0, want.ratio()))


def test_similar_texts_are_compared_on_all_cores(spark):
    """few small pairs were one task of slow comparisons, and so were the grams of few texts."""
    texts = spark.createDataFrame([(1, 0, 1, "a" * 60 + "b", 61), (1, 1, 2, "a" * 60 + "c", 61)], "doc_id long, side int, id int, norm string, len int").coalesce(1)
    near = links.similar_texts(texts)
    assert [tuple(r) for r in near.collect()] == [(1, 1, 2, 2 * 60 / 122)]
    cores = 2 * spark.sparkContext.defaultParallelism
    assert f"{max(cores, 4)}), REPARTITION_BY_NUM" in near._jdf.queryExecution().toString()


def test_evaluation_scans_only_clauses_that_differ(spark, folder, monkeypatch):
    """F16: all clauses of both sides were scanned for values, though equal texts hold equal ones."""
    scanned = []

    def extract(rows, keys, *kinds):
        scanned.append(rows.count())
        return entities.extract(rows, keys, *kinds)

    monkeypatch.setattr(rules, "extract", extract)
    got, want = both(spark, folder, "rul_findings")
    assert got == want
    differ = sum({0: 1, 1: 2, 2: 2, 3: 0, 4: 1, 5: 2}[k % 6] for k in range(1, 81))
    assert scanned == [differ, differ]


def test_drafts_write_only_clauses_that_a_selector_can_find(spark, folder, monkeypatch):
    """the texts of all clauses were written and exchanged seven times; other labels can match no selector."""
    written = []

    def clauses_of(*args, **kwargs):
        c = clauses.clauses_of(*args, **kwargs)
        written.append({r.label for r in c.select("label").distinct().collect()})
        return c

    monkeypatch.setattr(queries_policy, "clauses_of", clauses_of)
    for name in ("rul_drafts", "jn_resolve_candidate"):
        got, want = both(spark, folder, name)
        assert got == want and len(got) > 0
    assert written == [{"Article II"}, {"Article II"}]
    # A label that normalization may change stays, whatever is asked for.
    p = spark.createDataFrame([(1, 0, "第1条 价款"), (1, 1, "Article I Fees"), (1, 2, "ARTICLE II Term"), (2, 0, "Article II Term")], "doc_id long, ordinal int, text string")
    asked = spark.createDataFrame([(1, "article  ii")], "doc_id long, label string")
    assert sorted(r.label for r in clauses.clauses_of(p, ids=False, labels=asked).collect()) == ["ARTICLE II", "第1条"]


def test_title_like_exchanges_no_block_texts(spark, folder):
    """all blocks were exchanged to meet their page's width."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        df = catalog.QUERIES["prj_title_like"](spark, folder)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("REPARTITION_BY_NUM") == 2
    got, want = both(spark, folder, "prj_title_like")
    assert got == want and len(got) > 0


def test_values_of_clauses_are_searched_once(spark, folder):
    """the values of all clauses, with anchors and new values, were made anew for each of three uses."""
    df = catalog.QUERIES["win_edit_places"](spark, folder)
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
