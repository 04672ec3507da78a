"""Reports, pair status and bundle checks on small tables with nulls, ties and nothing at all."""

from revverify.operators import evaluate, reports


def test_durations_are_ranks(spark):
    rows = [(float(i % 7), None) for i in range(100)] + [(1e9, "timeout"), (None, None)]
    got = evaluate.durations(spark.createDataFrame(rows, "duration_s double, error string")).first()
    values = sorted(float(i % 7) for i in range(100))
    assert (got["median"], got["p95"]) == ((values[49] + values[50]) / 2, values[94])
    none = evaluate.durations(spark.createDataFrame([], "duration_s double, error string")).first()
    assert (none["median"], none["p95"]) == (0.0, 0.0)
    one = evaluate.durations(spark.createDataFrame([(3.5, None)], "duration_s double, error string")).first()
    assert (one["median"], one["p95"]) == (3.5, 3.5)


def test_draftability_and_applicability(spark):
    key = "source string, contract_id long, format string, operator string"
    cases = spark.createDataFrame([("a", 1, "pdf", "x"), ("a", 1, "pdf", "y"), ("a", 2, "pdf", "x")], key)
    refused = spark.createDataFrame([("a", 2, "pdf", "z"), ("b", 1, "pdf", "x")], key)
    failures = spark.createDataFrame([("q",), ("p",), ("p",), ("r",)], "reason string")
    assert tuple(reports.draftability(cases, refused, failures).first()) == (3, 7, 3 / 7)
    assert tuple(reports.draftability(cases.limit(0), refused.limit(0), failures.limit(0)).first()) == (0, 0, 0.0)
    assert [tuple(r) for r in reports.draft_failure_reasons(failures).orderBy("rank").collect()] == [("p", 2, 1), ("q", 1, 2), ("r", 1, 3)]
    assert {tuple(r) for r in reports.applicability(cases, refused).collect()} == {("x", 2, 1), ("y", 1, 0), ("z", 0, 1)}


def test_pair_status(spark):
    pairs = spark.createDataFrame([(i,) for i in range(4)], "pair_id long")
    changes = spark.createDataFrame([(1,), (1,), (2,)], "pair_id long")
    visual = spark.createDataFrame([(0, 0.0), (3, 0.1), (1, None)], "pair_id long, ratio double")
    warnings = spark.createDataFrame([(2, 3, "b"), (2, 1, "c"), (2, 2, "b"), (2, 9, "c")], "pair_id long, place int, warning string")
    got = {r["pair_id"]: (r["status"], r["warnings"]) for r in reports.pair_status(pairs, changes, visual, warnings).collect()}
    assert got == {0: ("unchanged", []), 1: ("changed", []), 2: ("partial", ["c", "b"]), 3: ("changed", [])}


def test_bounded_and_filtered(spark):
    rows = [("a", 1, "x" * 9), ("a", 2, None), ("b", 1, "y"), ("c", 1, "z"), ("c", 2, "z"), ("c", 3, "z" * 9)]
    out = reports.bounded(spark.createDataFrame(rows, "k string, n int, t string"), "k", ["n"], 2, {"t": 4}).collect()
    assert {(r["k"], r["n"], r["t"], r["total"], r["truncated"]) for r in out} == {("a", 1, "xxxx", 2, True), ("a", 2, None, 2, True), ("b", 1, "y", 1, False), ("c", 1, "z", 3, True), ("c", 2, "z", 3, True)}
    modes, kinds = ["minimal", "full", "sealed", "other", None], [k for _, more in reports.MODE_ADDS for k in more] + ["unknown", None]
    items = spark.createDataFrame([(m, k, "e" * 600) for m in modes for k in kinds], "mode string, kind string, excerpt string")
    got = reports.filter_evidence(items).collect()
    assert {m: sum(r["mode"] == m for r in got) for m in modes} == {"minimal": 3, "full": 5, "sealed": 6, "other": 0, None: 0}
    assert all((r["excerpt"] == "e" * 500) if r["kind"] == "excerpt" else r["excerpt"] is None for r in got)


def test_bundle_checks(spark):
    pairs = spark.createDataFrame([(1, "s", "s"), (2, "s", "t"), (3, None, None)], "pair_id long, before_sha string, after_sha string")
    same, rest = reports.split_unchanged(pairs)
    assert [r["pair_id"] for r in same.collect()] == [1] and sorted(r["pair_id"] for r in rest.collect()) == [2, 3]
    whole = spark.createDataFrame([(i, "p", "b", "c", "v") for i in range(3)], "bundle_id long, policy_sha string, baseline_sha string, candidate_sha string, verdict_sha string")
    assert reports.cross_digests(whole, whole, whole, whole, whole).count() == 0
    assert [r["bundle_id"] for r in reports.cross_digests(whole, whole, whole.where("bundle_id <> 1"), whole, whole).collect()] == [1]
    bundles = [(1, "local", False, None, False, False), (2, "local", False, "h", True, False), (3, "verified", True, "h", True, True), (4, "enterprise", True, "h", True, False)]
    got = reports.assurance_errors(spark.createDataFrame(bundles, "bundle_id long, assurance string, manifest_signed boolean, event_head string, policy_signed boolean, session_opened boolean")).collect()
    assert {tuple(r) for r in got} == {(2, "local_assurance_claim_invalid"), (2, "bundle_payload_set_invalid"), (4, "bundle_payload_set_invalid"), (4, "enterprise_assurance_adapter_unavailable")}


def test_history_and_evidence(spark):
    log = spark.createDataFrame([(b, i, i, i, "approve") for b, n in ((1, 5), (2, 2)) for i in range(1, n + 1)], "bundle_id long, sequence int, event_id long, finding_id long, decision string")
    got = {(r["bundle_id"], r["sequence"], r["next_cursor"], r["truncated"]) for r in reports.event_history(log, 1, 2).collect()}
    assert got == {(1, 2, 3, True), (1, 3, 3, True), (2, 2, None, False)}
    items = spark.createDataFrame([("a", "changed_region", [1, 1, 2]), ("b", "excerpt", [1]), ("c", "changed_region", None)], "path string, kind string, finding_ids array<long>")
    assert sorted(tuple(r) for r in reports.evidence_for(spark.createDataFrame([(1,), (3,)], "finding_id long"), items).collect()) == [(1, "a")]
