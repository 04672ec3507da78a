"""Operators on small golden tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from revverify.functions import text as fn
from revverify.operators import clauses, diff, entities, evaluate, events, grid, mutate, rules
from revverify.streaming import decisions


@pytest.mark.parametrize(
    "text,scheme,level,printed",
    [
        ("第四条 付款条件", "chinese_article", 1, "第四条"), ("第 4 条 付款条件", "chinese_article", 1, "第 4 条"), ("一、付款条件", "chinese_list", 2, "一、"),
        ("（一）付款时间", "chinese_list", 3, "（一）"), ("4.2 Payment timing", "decimal", 2, "4.2"), ("Article IV Payment Terms", "article", 1, "Article IV"),
        ("Section 4.2 Payment timing", "section", 2, "Section 4.2"), ("第1节 订立依据", "section", 1, "第1节"), ("Payment terms: Section 4.2", None, None, None),
    ],
)
def test_markers(spark, text, scheme, level, printed):
    m = spark.createDataFrame([(text,)], "t string").select(clauses.parse_marker(F.col("t")).alias("m")).first()["m"]
    assert (m and m["scheme"], m and m["level"], m and m["printed"]) == (scheme, level, printed)


def test_tree_equals_a_stack(spark):
    rnd = random.Random(1)
    rows = [(d, n, rnd.randrange(1, 7), f"h{n}") for d in range(20) for n in range(1, 25)]
    got = {(r["doc_id"], r["clause_no"]): r["parent_no"] for r in clauses.clause_tree(spark.createDataFrame(rows, "doc_id long, clause_no int, level int, heading string")).collect()}
    for d in range(20):
        stack = []
        for _, n, level, _ in rows[d * 24 : d * 24 + 24]:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[d, n] == (stack[-1][0] if stack else None)
            stack.append((n, level))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Party A: Acme Ltd; USD 2,000; 15 days", [("party", "Acme Ltd"), ("currency", "USD"), ("money", "2000"), ("duration", "15 day")]),
        ("CNYx is not a currency amount.", []), ("合同价款为人民币100万元。", [("currency", "CNY"), ("money", "1000000")]),
        ("违约金为百分之五。", [("percentage", "5")]), ("签订日期为2026年9月21日。", [("date", "2026-09-21")]), ("Fee: USD 2.5 billion.", [("currency", "USD"), ("money", "2500000000.0")]),
        ("Effective Date: 8th October, 2026.", [("date", "2026-10-08")]), ("February 30, 2026", []), ("Term: thirty (30) days.", [("duration", "30 day")]),
        ("保修期为两年。", [("duration", "2 year")]), ("自第三年起", []),
    ],
)
def test_entities(spark, text, want):
    rows = entities.extract(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).collect()
    got = [(r["kind"], r["value"]) for r in sorted(rows, key=lambda r: (r["pos"], r["kind"]))]
    assert sorted(got) == sorted(want)


def test_zh_numbers(spark):
    cases = {"五": 5, "十": 10, "三十": 30, "壹拾贰万叁仟肆佰伍拾陆": 123456, "一亿零三": 100000003, "x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", fn.zh_number(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {k: None if v is None else str(v) for k, v in cases.items()}  # decimal text, as fractions keep their digits


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(fn.normalized(F.lit("  Ｓtraße X "))) == "strasse x" and one(fn.norm(F.lit(" A  b "))) == "a b"
    assert [tuple(s) for s in one(fn.find_spans(F.lit("abxabx"), F.lit("ab")))] == [(0, 2), (3, 5)]
    assert one(fn.inc_first(F.lit("fee 99 and 3"))) == "fee 100 and 3" and one(fn.shift_date(F.lit("2024-02-29"))) == "2024-02-28"
    assert one(fn.dec_text(F.lit("2.5"), F.lit(1000000000))) == "2500000000.0" and one(fn.basename(F.lit("a\\b/c.txt"))) == "c.txt"
    assert not one(fn.is_pure_replacement(F.lit("Payment: RED; fee unchanged."), F.lit("Payment: BLUE; fee revised."), F.lit("RED"), F.lit("BLUE"), F.lit(1)))
    assert one(fn.shift_value(F.lit("USD 12,500"), F.lit("money"))) == "USD 13,500" and one(fn.ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    for s, n, lo, hi in ((0, 100, 0.0, 0.0370), (5, 100, 0.0215, 0.1118), (0, 0, 0.0, 0.0)):
        a, b = fn.wilson(F.lit(s), F.lit(n))
        assert (round(one(a), 4), round(one(b), 4)) == (lo, hi)


def blocks(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "pair_id long, ordinal int, key string")


@pytest.mark.parametrize(
    "before,after,want",
    [("12", "21", ["moved"]), ("dd", "", ["removed"] * 2), ("", "dd", ["added"] * 2), ("abc", "anbc", ["added"]), ("abc", "axc", ["added", "removed"])],
)
def test_block_diff(spark, before, after, want):
    assert sorted(r["kind"] for r in diff.block_diff(blocks(spark, *before), blocks(spark, *after)).collect()) == want


def test_greedy_pair_equals_a_loop(spark):
    rnd = random.Random(2)
    rows = [(g, b, a, rnd.randrange(5) / 4) for g in range(5) for b, a in itertools.product(range(4), range(5))]
    got = {(r["g"], r["b"], r["a"]) for r in diff.greedy_pair(spark.createDataFrame(rows, "g long, b int, a int, similarity double")).collect()}
    want, used = set(), set()
    for g, b, a, _ in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (g, "b", b) not in used and (g, "a", a) not in used:
            used |= {(g, "b", b), (g, "a", a)}
            want.add((g, b, a))
    assert got == want


def test_entity_and_multiset_diff(spark):
    e = lambda *v: spark.createDataFrame([(1, 1, "duration", x) for x in v], "pair_id long, b int, kind string, value string")
    assert [tuple(r) for r in diff.entity_diff(e("30 day", "5 day"), e("45 day", "5 day")).collect()] == [(1, 1, "duration", "30 day", "45 day")]
    assert diff.facts_equal(e("a", "a"), e("a"), ["value"]).first()["equal"] is False


@pytest.mark.parametrize(
    "expected,changed,protected,pad,outcome",
    [
        ([(10, 10, 80, 30)], (4, 4, 86, 36), [], 6, "pass"), ([(10, 10, 80, 30)], (3.999, 4, 86, 36), [], 6, "review"), ([(10, 10, 20, 20), (20, 10, 30, 20)], (15, 10, 25, 20), [], 0, "pass"),
        ([(10, 10, 22, 20), (18, 10, 30, 20)], (15, 10, 25, 20), [], 0, "pass"), ([(10, 10, 20, 20), (30, 10, 40, 20)], (15, 10, 35, 20), [], 0, "review"),
        ([(10, 10, 20, 20), (20, 10, 30, 20)], (12, 12, 20, 20), [(15, 15, 25, 25)], 6, "fail"),
    ],
)
def test_regions(spark, expected, changed, protected, pad, outcome):
    box = "pair_id long, x0 double, y0 double, x1 double, y1 double"
    b = lambda v: spark.createDataFrame([(1, *map(float, x)) for x in v], box)
    c = spark.createDataFrame([(1, 1, *map(float, changed))], "pair_id long, rect_id long, x0 double, y0 double, x1 double, y1 double")
    assert grid.region_outcome(c, b(expected), b(protected), pad).first()["outcome"] == outcome


def test_tiles(spark):
    cells = spark.createDataFrame([(1, x, y) for x, y in ((1, 1), (9, 1), (1, 9), (9, 9), (33, 1))], "page_id long, x int, y int")
    got = {(r["x0"] * 8, r["y0"] * 8, r["x1"] * 8, r["y1"] * 8) for r in grid.coalesce_tiles(grid.changed_tiles(cells, 8)).collect()}
    assert got == {(0, 0, 16, 16), (32, 0, 40, 8)}


def log(spark, rows):
    return spark.createDataFrame(rows, "bundle_id long, sequence long, event_id long, finding_id long, decision string, previous_digest string, event_digest string")


def test_chain_and_stream(spark, tmp_path):
    head = spark.range(1).select(F.sha2(F.lit("1"), 256)).first()[0]
    rows = [(1, 1, 1, 5, "approve", head, "a"), (1, 2, 2, 6, "reject", "a", "b"), (1, 4, 3, 7, "approve", "b", "c"), (2, 1, 4, 1, "approve", "bad", "x")]
    got = {r["event_id"]: r["error"] for r in events.validate_chain(log(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: "sequence", 4: "previous-digest"}
    log(spark, rows[:2] + [(1, 3, 9, 5, "approve", "b", "d"), (1, 4, 3, 7, "approve", "d", "c")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log(spark, []).schema).parquet(str(tmp_path / "in"))
    q = decisions.stream_effective(stream).writeStream.format("memory").queryName("effective").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["error"] for r in spark.table("effective").collect()} == {1: None, 2: None, 9: "repeated-finding", 3: None}


def test_trust_and_verdict(spark):
    signed = spark.createDataFrame([("a", "f", "2024-05-01"), ("a", "g", "2024-05-01"), ("b", "f", "2030-01-01")], "signer_id string, signer_fp string, at string").withColumn("at", F.to_timestamp("at"))
    ids = spark.createDataFrame([("a", "f", ["approver"], False, None, None), ("b", "f", ["approver"], False, None, "2029-01-01")], "identity_id string, fp string, roles array<string>, revoked boolean, valid_from string, valid_until string")
    ids = ids.withColumn("valid_from", F.to_timestamp("valid_from")).withColumn("valid_until", F.to_timestamp("valid_until"))
    assert {(r["signer_id"], r["signer_fp"]): r["trusted"] for r in events.currently_trusted(signed, ids, "approver").collect()} == {("a", "f"): True, ("a", "g"): False, ("b", "f"): False}


def test_every_mutation_is_caught(spark):
    texts = ["MASTER SERVICES AGREEMENT", "Article I Parties", "Party A: Acme Inc.; This agreement is made on 2026-08-04.", "Article II Payment Terms", "The Customer shall pay within 30 days of receipt. Each invoice may list 12 items.", "Article III Fees", "The fee is USD 12,500 at 2% per month. The Supplier shall not disclose data."]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "contract_id long, ordinal int, text string")
    e = spark.createDataFrame([(1, 4, "30 days", "45 days")], "contract_id long, site int, before string, after string")
    side = lambda df: df.withColumnRenamed("contract_id", "pair_id")
    for name in ("authorized", "wrong_value", "party_change", "modal_swap"):
        _, v = rules.verdicts(side(p), side(mutate.candidates(p, e, name)), side(e))
        assert v.first()["verdict"] == ("pass" if name == "authorized" else "fail"), name


def test_metrics(spark):
    rows = [
        ("s", "c1", "docx", "authorized", "accept", "pass", [], 500, None), ("s", "c2", "docx", "authorized", "accept", "fail", ["expected", "clause"], 2500, None), ("s", "c3", "docx", "authorized", "accept", "fail", ["expected"], 6000, None),
        ("s", "c1", "docx", "money", "block", "pass", [], 500, None), ("s", "c2", "docx", "money", "block", "fail", [], 500, None), ("s", "c1", "docx", "modal", "block", "review", [], 500, None), ("s", "c2", "docx", "modal", "block", None, [], 500, "timeout"),
    ]
    c = spark.createDataFrame(rows, "source string, contract_id string, format string, operator string, expectation string, text_verdict string, rule_ids array<string>, chars long, error string")
    top = evaluate.false_pass(c).where("level = 'overall'").first()
    assert (top["passed"], top["total"]) == (1, 3)
    assert tuple(evaluate.acceptance(c).first()) == (1, 3) and evaluate.false_pass(evaluate.discriminating(c)).where("level = 'overall'").first()["total"] == 2
    assert [tuple(r) for r in evaluate.false_block_reasons(c).collect()] == [("expected", 2), ("clause", 1)]
    assert {r["bucket"]: (r["accepted"], r["total"]) for r in evaluate.acceptance_by_bucket(c).collect()} == {"<1k": (1, 1), "1-2k": (0, 0), "2-5k": (0, 1), ">5k": (0, 1)}
