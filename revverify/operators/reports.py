"""Run reports, pair status, bounded listings, evidence filters and checks across the parts of a bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Kinds of evidence that each privacy mode adds to those of the mode before it.
MODE_ADDS = (
    ("minimal", ("source_hash", "excerpt", "changed_region")),
    ("full", ("full_page", "full_report")),
    ("sealed", ("source_contract",)),
)
EXCERPT_CHARACTERS = 500


def draftability(cases: DataFrame, not_applicable: DataFrame, failures: DataFrame) -> DataFrame:
    """AGG-15: one row: contracts with a draft (source, contract_id, format of a case or of an edit that did not apply), all with the failures, and the rate."""
    key = ["source", "contract_id", "format"]
    ready = cases.select(*key).union(not_applicable.select(*key)).distinct().agg(F.count("*").alias("draftable"))
    lost = failures.agg(F.count("*").alias("lost"))
    both = ready.join(F.broadcast(lost))  # one row each
    total = F.col("draftable") + F.col("lost")
    return both.select("draftable", total.alias("total"), F.when(total > 0, F.col("draftable") / total).otherwise(0.0).alias("rate"))


def draft_failure_reasons(failures: DataFrame) -> DataFrame:
    """AGG-15, ORD-04: reasons of draft failures with their counts and rank, most frequent first."""
    counts = failures.groupBy("reason").agg(F.count("*").alias("n"))  # a row a reason
    return counts.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("n"), "reason")))


def applicability(cases: DataFrame, not_applicable: DataFrame) -> DataFrame:
    """AGG-16: cases and refusals of each operator, of all operators that have either."""
    a = cases.groupBy("operator").agg(F.count("*").alias("applicable"))
    b = not_applicable.groupBy("operator").agg(F.count("*").alias("not_applicable"))
    return a.join(b, "operator", "full_outer").na.fill(0, ["applicable", "not_applicable"])


def distinct_ordered(values: Column) -> Column:
    """SET-09: each value of an array once, where it stands first."""
    return F.array_distinct(values)


def pair_status(pairs: DataFrame, changes: DataFrame, visual: DataFrame, warnings: DataFrame) -> DataFrame:
    """AGG-22, SET-09: status of each pair (pair_id): partial with warnings (pair_id, place, warning), else changed with a change (pair_id) or a
    visual ratio (pair_id, ratio) above 0, else unchanged; and its warnings in order, each once."""
    c = changes.groupBy("pair_id").agg(F.count("*").alias("changes"))
    v = visual.groupBy("pair_id").agg(F.max("ratio").alias("ratio"))
    w = warnings.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("place", "warning"))).alias("w"))
    j = pairs.join(c, "pair_id", "left").join(v, "pair_id", "left").join(w, "pair_id", "left")
    listed = distinct_ordered(F.coalesce(F.transform("w", lambda x: x["warning"]), F.array().cast("array<string>")))
    differs = (F.coalesce("changes", F.lit(0)) > 0) | F.coalesce(F.col("ratio") > 0, F.lit(False))
    return j.withColumn("warnings", listed).select("pair_id", F.when(F.size("warnings") > 0, "partial").when(differs, "changed").otherwise("unchanged").alias("status"), "warnings")


def bounded(df: DataFrame, key: str, order: list[str], n: int, caps: dict[str, int]) -> DataFrame:
    """PRJ-03: the first n rows of each key in order, with strings cut to their caps, ``total`` rows of the key and whether anything was left out."""
    by = W.Window.partitionBy(key)
    cut = reduce(lambda a, b: a | b, (F.coalesce(F.length(c) > most, F.lit(False)) for c, most in caps.items()), F.lit(False))
    out = df.withColumn("_n", F.row_number().over(by.orderBy(*order))).withColumn("total", F.count("*").over(by))
    out = out.withColumn("truncated", (F.col("total") > n) | F.max(cut & (F.col("_n") <= n)).over(by)).where(F.col("_n") <= n).drop("_n")
    return out.withColumns({c: F.substring(c, 1, most) for c, most in caps.items()})


def filter_evidence(items: DataFrame) -> DataFrame:
    """PRJ-08: the items (mode, kind, excerpt, ..) that their bundle's privacy mode allows; excerpts are cut to 500 characters, other kinds carry none."""
    kinds = [k for _, more in MODE_ADDS for k in more]
    known = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    ends = [sum(len(m) for _, m in MODE_ADDS[: i + 1]) for i in range(len(MODE_ADDS))]
    upto = F.create_map(*[x for (mode, _), end in zip(MODE_ADDS, ends, strict=True) for x in (F.lit(mode), F.lit(end))])
    ok = items.where(F.coalesce(F.try_element_at(known, F.col("kind")) < F.try_element_at(upto, F.col("mode")), F.lit(False)))
    return ok.withColumn("excerpt", F.when(F.col("kind") == "excerpt", F.substring("excerpt", 1, EXCERPT_CHARACTERS)))


def split_unchanged(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-13: (pairs with equal digests of both sides, which need no further stage; all others)."""
    same = F.coalesce(F.col("before_sha") == F.col("after_sha"), F.lit(False))
    return pairs.where(same).withColumn("status", F.lit("unchanged")), pairs.where(~same)


def evidence_for(findings: DataFrame, items: DataFrame) -> DataFrame:
    """JN-19: changed regions (path, kind, finding_ids) of each finding (finding_id)."""
    linked = items.where("kind = 'changed_region'").select("path", F.explode(F.array_distinct("finding_ids")).alias("finding_id"))
    return findings.join(linked, "finding_id")


def event_history(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    """WIN-18, ORD-03: a page of each bundle's events in order, with total, next_cursor (null at the end) and truncated."""
    by = W.Window.partitionBy("bundle_id")
    out = log.withColumn("_n", F.row_number().over(by.orderBy("sequence", "event_id"))).withColumn("total", F.count("*").over(by))
    out = out.where((F.col("_n") > cursor) & (F.col("_n") <= cursor + limit))
    after = F.when(F.col("total") > cursor + limit, F.lit(cursor + limit).cast("long"))
    return out.select("bundle_id", "sequence", "event_id", "finding_id", "decision", "total", after.alias("next_cursor"), after.isNotNull().alias("truncated"))


def cross_digests(manifests: DataFrame, policies: DataFrame, facts: DataFrame, verdicts: DataFrame, comparisons: DataFrame) -> DataFrame:
    """RUL-18: bundles whose parts name other digests than their manifest (bundle_id, policy_sha, baseline_sha, candidate_sha, verdict_sha).

    A part that is missing disagrees. policies: policy_sha; facts and comparisons: baseline_sha, candidate_sha; verdicts: these and policy_sha, verdict_sha.
    """
    parts = {"p": (policies, ["policy_sha"]), "f": (facts, ["baseline_sha", "candidate_sha"]), "c": (comparisons, ["baseline_sha", "candidate_sha"]), "v": (verdicts, ["policy_sha", "baseline_sha", "candidate_sha", "verdict_sha"])}
    # Of each part one short digest of its digests goes through the joins, null where one of them is. The tables grow with the bundles, so none is sent whole to every task.
    one = lambda cols: F.unhex(F.sha2(F.concat(*[x for c in cols for x in (F.octet_length(c).cast("string"), F.lit(":"), F.col(c))]), 256))
    j, equal = manifests.select("bundle_id", *[one(cols).alias(f"m_{name}") for name, (_, cols) in parts.items()]), F.lit(True)
    for name, (df, cols) in parts.items():
        j = j.join(df.select("bundle_id", one(cols).alias(name)).hint("merge"), "bundle_id", "left")
        equal &= F.coalesce(F.col(name) == F.col(f"m_{name}"), F.lit(False))
    return j.where(~equal).select("bundle_id", F.lit("bundle_cross_digest_invalid").alias("error"))


def assurance_errors(bundles: DataFrame) -> DataFrame:
    """RUL-19: errors of bundles (bundle_id, assurance, manifest_signed, event_head, policy_signed, session_opened).

    Local bundles carry neither signature nor event; all others need the policy's signature and the opening event; enterprise is not supported.
    """
    local = F.col("assurance") == "local"
    extra = F.col("policy_signed") | F.col("session_opened")
    found = F.array(
        F.when(local & (F.col("manifest_signed") | F.col("event_head").isNotNull()), "local_assurance_claim_invalid"),
        F.when((local & extra) | (~local & ~(F.col("policy_signed") & F.col("session_opened"))), "bundle_payload_set_invalid"),
        F.when(F.col("assurance") == "enterprise", "enterprise_assurance_adapter_unavailable"),
    )
    return bundles.select("bundle_id", F.explode(F.array_compact(found)).alias("error"))
