"""Findings of round 4: what verdicts write and exchange, and queries against their SQL on a folder made for them."""

import datetime
import difflib
import itertools
import random
from collections import Counter

import duckdb
import pytest

from revverify import catalog, queries, queries_policy
from revverify.operators import clauses, diff, entities, links, mutate, rules
from revverify.plans.materialize import kept
from revverify.sources.corpus import contract_paragraphs, declared_edits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, day = str(tmp_path_factory.mktemp("orders")), datetime.datetime(2024, 3, 4)
    spark.createDataFrame([(k, f"Customer#{k}") for k in range(4)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(k, k % 4, day, 1000.0 + k) for k in range(1, 61)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(f"{at}/orders.parquet")
    items = [(k, n, n % 3, n % 2, 5.0, day + datetime.timedelta(days=n)) for k in range(1, 61) for n in range(1, 2 + k % 4)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return at


def both(spark, folder, name) -> tuple[Counter, Counter]:
    d = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return Counter(map(tuple, catalog.QUERIES[name](spark, folder).collect())), Counter(d.sql(catalog.ORACLES[name]).fetchall())


def sides(spark, folder, operator):
    p = contract_paragraphs(spark, folder, edits=True)
    both_ = mutate.both_sides(p, None, operator).withColumnRenamed("contract_id", "pair_id")
    return clauses.plain_clauses(both_, ("pair_id", "side")), declared_edits(p).withColumnRenamed("contract_id", "pair_id")


def test_verdicts_exchange_no_paragraphs_and_keep_only_clauses_that_tell(spark, folder):
    """All clauses of both sides were written with their texts and exchanged seven times, and paragraphs were made four times over."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as of large tables
    try:
        c, e = sides(spark, folder, "money_change")
        plan = c._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Generate posexplode") == 1
    assert "Exchange " not in plan[: plan.index("Generate posexplode")]
    matched, base, cand, ids = diff.matched_sides(c, e)
    assert ids.count() == 60
    assert Counter(r.label for r in base.collect()) == Counter(r.label for r in cand.collect()) == {"Article II": 60, "Article III": 60}
    assert all(df.count() == 0 for df in matched[1:])


def test_both_sides_are_baseline_and_candidate(spark, folder):
    p, carried = contract_paragraphs(spark, folder), contract_paragraphs(spark, folder, edits=True)
    rows = lambda df: Counter((r.contract_id, r.ordinal, r.text) for r in df.collect())
    for operator in mutate.OPERATORS:
        got = mutate.both_sides(carried, None, operator)
        cand = mutate.candidates(p, declared_edits(p), operator)
        assert rows(got.where("side = 1")) == rows(cand)
        assert rows(got.where("side = 0")) == rows(p.join(cand.select("contract_id").distinct(), "contract_id", "left_semi"))


def test_changes_of_sides_are_those_of_all_clauses(spark):
    """Clauses with equal identities, moved, crossed, renamed, gone and new, and white space and case that normalization takes away."""
    rnd, rows = random.Random(4), []
    for pair in range(150):
        heads = [(rnd.choice("AB"), rnd.choice(["x", "y", "Z"]), rnd.choice([[], ["p"], ["P", "q"]])) for _ in range(rnd.randrange(1, 7))]
        docs = [[(*h, rnd.choice(["one", "two  words", "ß", ""])) for h in heads]]
        other = [(lab, head, path, text if rnd.random() < 0.7 else rnd.choice([text.upper(), "Two words", "ss", "new"])) for lab, head, path, text in docs[0]]
        other = [(lab if rnd.random() < 0.9 else "C", head.upper() if rnd.random() < 0.2 else head, [s.lower() for s in path] if rnd.random() < 0.3 else path, text) for lab, head, path, text in other if rnd.random() < 0.9]
        if rnd.random() < 0.5:
            rnd.shuffle(other)
        docs.append(other)
        rows += [(pair, side, n, lab, head, path, text) for side, d in enumerate(docs) for n, (lab, head, path, text) in enumerate(d)]
    c = spark.createDataFrame(rows, "pair_id long, side int, clause_no int, label string, heading string, ancestor_path array<string>, text string")
    got = diff.changes_of_sides(diff.matched_sides(c)[0])
    one = lambda k: c.where(f"side = {k}").withColumn("fp", diff.fp(diff.normalized(diff.F.col("text"))))
    want = diff.clause_changes(one(0), one(1))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert {r.kind for r in got.collect()} == {"added", "removed", "modified", "moved", "unresolved"}


@pytest.mark.parametrize("name", ["clause_changes_by_kind", "rul_verdict_policies", *(f"rul_verdict_{o}" for o in ("authorized", "missing_edit", "unit_change", "paragraph_delete", "sentence_insert", "party_change"))])
def test_verdicts_equal_their_sql(spark, folder, name):
    got, want = both(spark, folder, name)
    assert got == want and len(got) > 0


def test_verdicts_of_two_tables(spark):
    """The same step for baselines and candidates that come apart: an edit in a clause without partner, a pair without baseline, one without candidate."""
    base = spark.createDataFrame([(1, 0, "Article I A"), (1, 1, "pay in 5 days"), (2, 0, "Article I A"), (2, 1, "pay in 5 days"), (3, 0, "Article I A")], "pair_id long, ordinal int, text string")
    cand = spark.createDataFrame([(1, 0, "Article I A"), (1, 1, "pay in 6 days"), (2, 0, "Article I B"), (2, 1, "pay in 6 days"), (4, 0, "Article I A")], "pair_id long, ordinal int, text string")
    edits = spark.createDataFrame([(k, "5 days", "6 days") for k in (1, 2, 3)], "pair_id long, before string, after string")
    found, verdict = rules.verdicts(base, cand, edits)
    assert {tuple(r)[:2] for r in verdict.collect()} == {(1, "pass"), (2, "fail"), (3, "fail")}
    assert {(r.pair_id, r.rule_id) for r in found.collect()} >= {(2, "expected.authorized"), (2, "clause.unexplained"), (3, "clause.unexplained")}


def test_grams_of_a_document_are_not_exchanged(spark):
    """each gram of each line was a row that was exchanged twice to be counted and ranked; now only the rare ones leave their document."""
    rnd, rows = random.Random(7), []
    for doc in range(12):
        lines = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 160))) for _ in range(8)] + ["", "ab" * 70]
        other = [s if rnd.random() < 0.4 else "".join(c if rnd.random() > 0.008 else rnd.choice("xyé") for c in s) for s in lines]
        for side, texts in enumerate((lines, other)):
            rows += [(doc, side, i, t, len(t)) for i, t in enumerate(dict.fromkeys(texts))]
    texts = spark.createDataFrame(rows, "doc_id long, side int, id int, norm string, len int")
    plan = links._signature(texts, links.LEAST)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan
    got = {(r.doc_id, r.l, r.r): r.similarity for r in links.similar_texts(texts).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {(d, i, j): ratio(a, b) for d, s, i, a, _ in rows for e, t, j, b, _ in rows if d == e and (s, t) == (0, 1) and ratio(a, b) >= 0.98}
    assert got == want and any(v < 1 for v in want.values())


def test_anchors_in_order_take_many_pairs_in_a_batch(spark):
    """each pair was a pandas group of its own, a few milliseconds for four rows."""
    rnd = random.Random(24)
    cases = [[rnd.randrange(12) for _ in range(rnd.randrange(1, 9))] for _ in range(200)]
    rows = [(p, b, a) for p, c in enumerate(cases) for b, a in enumerate(dict.fromkeys(c))]
    rnd.shuffle(rows)
    got = diff.in_order_anchors(spark.createDataFrame(rows, "pair_id long, b int, a int"))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == [("pair_id", "bigint"), ("b", "int"), ("a", "int")]
    by = {}
    for r in got.collect():
        by.setdefault(r.pair_id, []).append((r.b, r.a))
    for p, c in enumerate(cases):
        c, kept_ = list(enumerate(dict.fromkeys(c))), sorted(by[p])
        assert set(kept_) <= set(c) and all(x[1] < y[1] for x, y in itertools.pairwise(kept_))
        best = max(len(s) for n in range(len(c) + 1) for s in itertools.combinations([a for _, a in c], n) if list(s) == sorted(s))
        assert len(kept_) == best


def test_written_tables_are_not_sent_whole_for_their_file_size(spark):
    """millions of rows with repeated values make a file of a few MB, which was taken for the rows' size and broadcast."""
    t = kept(spark.range(600_000).selectExpr("id AS k", "'the same text again and again' AS v"))
    other = kept(spark.range(600_000).selectExpr("id AS k", "'another' AS w"))
    assert "BroadcastHashJoin" not in t.join(other, "k")._jdf.queryExecution().executedPlan().toString()


def test_only_paragraphs_that_the_edit_changes_are_scanned(spark, folder, monkeypatch):
    """all paragraphs of both sides were scanned for durations."""
    scanned = []
    monkeypatch.setattr(queries.entities, "extract", lambda rows, *args, f=entities.extract: (scanned.append(rows.count()), f(rows, *args))[1])
    got, want = both(spark, folder, "set_entity_changes")
    assert got == want and len(got) == 60 and scanned == [60, 60]


def test_written_clauses_hold_what_is_asked(spark, folder, monkeypatch):
    """All clauses were written with texts, norms and fingerprints; ids need none of them, simulated edits only clauses that a rule can find."""
    written = []
    monkeypatch.setattr(queries, "kept", lambda df: (written.append(df.columns), kept(df))[1])
    got, want = both(spark, folder, "win_clause_ids")
    assert got == want and written == [["contract_id", "clause_no", "parent_no", "clause_id"]]
    labels = []
    monkeypatch.setattr(queries_policy, "clauses_of", lambda *a, **k: (c := clauses.clauses_of(*a, **k), labels.extend({r.label for r in c.collect()}))[0])
    got, want = both(spark, folder, "rul_postedit_errors")
    assert got == want and labels == ["Article II"]
