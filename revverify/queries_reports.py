"""Queries of run reports, pair status, bounded listings and bundle checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import events, reports
from .registry import query
from .sources.corpus import table

RUN_SQL = """run AS (SELECT o_orderkey AS k, o_orderpriority AS source, o_custkey AS contract_id, CASE WHEN o_orderkey % 2 = 0 THEN 'docx' ELSE 'pdf' END AS format,
'op-' || o_custkey % 18 AS operator, CASE WHEN o_orderkey % 11 = 0 THEN 'failure' WHEN o_orderkey % 5 = 0 THEN 'refused' ELSE 'case' END AS part, 'no-' || lower(o_orderstatus) AS reason FROM orders)"""


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, refusals and draft failures derived from orders."""
    k = F.col("o_orderkey")
    part = F.when(k % 11 == 0, "failure").when(k % 5 == 0, "refused").otherwise("case")
    run = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("contract_id"), F.when(k % 2 == 0, "docx").otherwise("pdf").alias("format"),
        F.concat(F.lit("op-"), (F.col("o_custkey") % 18).cast("string")).alias("operator"), part.alias("part"), F.concat(F.lit("no-"), F.lower("o_orderstatus")).alias("reason"),
    )
    return run.where("part = 'case'"), run.where("part = 'refused'"), run.where("part = 'failure'")


@query(f"""WITH {RUN_SQL}, a AS (SELECT count(*) AS draftable FROM (SELECT DISTINCT source, contract_id, format FROM run WHERE part <> 'failure')), b AS (SELECT count(*) AS lost FROM run WHERE part = 'failure')
SELECT draftable, draftable + lost AS total, CASE WHEN draftable + lost > 0 THEN draftable / (draftable + lost) ELSE 0.0 END::DOUBLE AS rate FROM a, b""")
def agg_draftability(spark, sf_dir):
    """AGG-15."""
    return reports.draftability(*_run(spark, sf_dir))


@query(f"WITH {RUN_SQL} SELECT reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, reason)::INTEGER AS rank FROM run WHERE part = 'failure' GROUP BY 1")
def agg_draft_failure_reasons(spark, sf_dir):
    """AGG-15, ORD-04."""
    return reports.draft_failure_reasons(_run(spark, sf_dir)[2])


@query(f"WITH {RUN_SQL} SELECT operator, count(*) FILTER (part = 'case') AS applicable, count(*) FILTER (part = 'refused') AS not_applicable FROM run WHERE part <> 'failure' GROUP BY 1")
def agg_applicability(spark, sf_dir):
    """AGG-16."""
    return reports.applicability(*_run(spark, sf_dir)[:2])


@query("""SELECT o_orderkey AS pair_id, CASE WHEN len(w) > 0 THEN 'partial' WHEN n > 0 OR r > 0 THEN 'changed' ELSE 'unchanged' END AS status, coalesce(w, []) AS warnings FROM orders LEFT JOIN (
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n, max(CASE WHEN l_discount > 0.08 THEN l_discount ELSE 0 END) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN (
SELECT l_orderkey AS k, list(flags ORDER BY p, flags) AS w FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS flags, min(l_linenumber) AS p FROM lineitem WHERE l_tax >= 0.08 GROUP BY 1, 2) GROUP BY 1) ON k = o_orderkey""")
def agg_pair_status(spark, sf_dir):
    """AGG-22, SET-09: orders as pairs, their items as changes, visual ratios and warnings."""
    item = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "pair_id")
    ratio = F.when(F.col("l_discount") > 0.08, F.col("l_discount")).otherwise(0.0)
    warn = item.where("l_tax >= 0.08").select("pair_id", F.col("l_linenumber").alias("place"), F.concat("l_returnflag", "l_linestatus").alias("warning"))
    return reports.pair_status(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id")), item.where("l_returnflag = 'R'"), item.select("pair_id", ratio.alias("ratio")), warn)


@query("""SELECT conv_id, turn, role, text[1:40] AS text, total, total > 3 OR long AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
JOIN (SELECT conv_id AS c, bool_or(coalesce(length(text) > 40, false)) AS long FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n <= 3 GROUP BY 1) ON c = conv_id WHERE n <= 3""")
def prj_bounded(spark, sf_dir):
    """PRJ-03: the first three turns of every conversation with texts of at most 40 characters."""
    return reports.bounded(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], 3, {"text": 40}).select("conv_id", "turn", "role", "text", "total", "truncated")


@query("""SELECT doc_id, mode, kind, CASE WHEN kind = 'excerpt' THEN text[1:500] END AS excerpt FROM (SELECT doc_id, text, ['minimal', 'full', 'sealed'][doc_id % 3 + 1] AS mode,
['source_hash', 'excerpt', 'changed_region', 'full_page', 'full_report', 'source_contract', 'other'][doc_id % 7 + 1] AS kind FROM documents)
WHERE kind IN ('source_hash', 'excerpt', 'changed_region') OR mode IN ('full', 'sealed') AND kind IN ('full_page', 'full_report') OR mode = 'sealed' AND kind = 'source_contract'""")
def prj_filter_evidence(spark, sf_dir):
    """PRJ-08: documents as evidence of bundles of all modes."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    kinds = [k for _, more in reports.MODE_ADDS for k in more] + ["other"]
    items = table(spark, sf_dir, "documents").select("doc_id", pick([m for m, _ in reports.MODE_ADDS], 3).alias("mode"), pick(kinds, 7).alias("kind"), F.col("text").alias("excerpt"))
    return reports.filter_evidence(items)


@query("""SELECT a.doc_id AS pair_id, CASE WHEN a.text = b.text THEN 'unchanged' ELSE 'open' END AS status FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def prj_split_unchanged(spark, sf_dir):
    """PRJ-13: every document against the next one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha"))
    pairs = d.select(F.col("doc_id").alias("pair_id"), F.col("sha").alias("before_sha")).join(d.select((F.col("doc_id") - 1).alias("pair_id"), F.col("sha").alias("after_sha")), "pair_id")
    same, rest = reports.split_unchanged(pairs)
    return same.unionByName(rest.withColumn("status", F.lit("open"))).select("pair_id", "status")


@query("""SELECT l_orderkey * 10 + l_linenumber AS finding_id, 'crop/' || o_orderkey AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_linenumber IN (1, 3) AND o_orderkey % 3 = 0""")
def jn_evidence_for(spark, sf_dir):
    """JN-19: order items as findings, orders as evidence of their first and third item."""
    findings = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"))
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("crop/"), k.cast("string")).alias("path"), F.when(k % 3 == 0, "changed_region").otherwise("excerpt").alias("kind"), F.array(k * 10 + 1, k * 10 + 3, k * 10 + 1).alias("finding_ids"))
    return reports.evidence_for(findings, items)


@query("""SELECT user_id AS bundle_id, n::INTEGER AS sequence, event_id, event_id % 7 AS finding_id, CASE WHEN event_type = 'error' THEN 'reject' ELSE 'approve' END AS decision, total, CASE WHEN total > 15 THEN 15::BIGINT END AS next_cursor, total > 15 AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE n > 5 AND n <= 15""")
def win_event_history(spark, sf_dir):
    """WIN-18, ORD-03: events 6 to 15 of every decision log."""
    return reports.event_history(events.decision_log(table(spark, sf_dir, "events")), 5, 10)


@query("""SELECT o_orderkey AS bundle_id, 'bundle_cross_digest_invalid' AS error FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 OR o_orderkey % 23 = 0""")
def rul_cross_digests(spark, sf_dir):
    """RUL-18: orders as bundles; some parts name another digest, some are missing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sha = lambda part: F.sha2(F.concat_ws("|", F.lit(part), k.cast("string"), F.col("o_orderdate").cast("string")), 256)
    base = o.select(k.alias("bundle_id"), *[sha(p).alias(f"{p}_sha") for p in ("policy", "baseline", "candidate", "verdict")])
    b = F.col("bundle_id")
    policies = base.withColumn("policy_sha", F.when(b % 13 == 0, F.lit("other")).otherwise(F.col("policy_sha")))
    facts = base.withColumn("candidate_sha", F.when(b % 17 == 0, F.col("baseline_sha")).otherwise(F.col("candidate_sha")))
    verdicts = base.withColumn("verdict_sha", F.when(b % 23 != 0, F.col("verdict_sha")))
    return reports.cross_digests(base, policies, facts, verdicts, base.where("bundle_id % 19 <> 0"))


@query("""WITH b AS (SELECT o_orderkey AS bundle_id, o_orderkey % 3 AS a, o_orderkey % 5 = 0 AS s, o_orderkey % 7 = 0 AS e, o_orderkey % 11 = 0 AS lost FROM orders)
SELECT bundle_id, unnest(CASE a WHEN 0 THEN list_concat(CASE WHEN s OR e THEN ['local_assurance_claim_invalid'] ELSE [] END, CASE WHEN lost THEN ['bundle_payload_set_invalid'] ELSE [] END)
WHEN 1 THEN CASE WHEN lost THEN ['bundle_payload_set_invalid'] ELSE [] END ELSE list_concat(CASE WHEN lost THEN ['bundle_payload_set_invalid'] ELSE [] END, ['enterprise_assurance_adapter_unavailable']) END) AS error FROM b""")
def rul_assurance_errors(spark, sf_dir):
    """RUL-19: orders as bundles of all three assurances, some with too many or too few parts."""
    k = F.col("o_orderkey")
    local, lost = k % 3 == 0, k % 11 == 0
    bundles = table(spark, sf_dir, "orders").select(
        k.alias("bundle_id"), F.when(local, "local").when(k % 3 == 1, "verified").otherwise("enterprise").alias("assurance"), (k % 5 == 0).alias("manifest_signed"),
        F.when(k % 7 == 0, F.col("o_orderstatus")).alias("event_head"), F.when(local, F.lit(False)).otherwise(~lost).alias("policy_signed"), F.when(local, lost).otherwise(F.lit(True)).alias("session_opened"),
    )
    return reports.assurance_errors(bundles)
