"""Queries of outputs: published bundles, verification records, result lines and the report, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import canon
from .operators import outputs
from .plans.materialize import kept, shared_folder
from .queries import CASE_SQL, _cases
from .registry import query
from .sources.corpus import table


def payloads(spark, sf_dir) -> DataFrame:
    """A bundle for each order: its policy, and a payload for each line item."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), F.lit("core/policy.json").alias("path"), F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('"}')).alias("content"))
    item = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), "l_returnflag")
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(item).alias("content"))  # noqa: E741
    return o.union(l.select("l_orderkey", F.concat(F.lit("core/evidence/"), F.col("l_linenumber").cast("string")), "content"))


BUNDLE_SQL = """item AS (SELECT l_orderkey AS bundle_id, 'core/evidence/' || l_linenumber AS path, max(l_partkey || '|' || l_quantity::BIGINT || '|' || l_returnflag) AS content FROM lineitem GROUP BY l_orderkey, l_linenumber),
pay AS (SELECT o_orderkey AS bundle_id, 'core/policy.json' AS path, '{"status":"' || o_orderstatus || '"}' AS content FROM orders UNION ALL SELECT * FROM item),
man AS (SELECT bundle_id, sha256(string_agg(path || '|' || sha256(content) || '|' || strlen(content), chr(10) ORDER BY path)) AS manifest_digest, count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM pay GROUP BY 1)"""


@query(f"WITH {BUNDLE_SQL} SELECT manifest_digest, any_value(files) AS files, any_value(bytes) AS bytes, 1::BIGINT AS times, true AS valid FROM man GROUP BY 1")
def src_publish_bundles(spark, sf_dir):
    """SRC-08: half of the bundles published, then all of them, then all again: each lies there once, under the digest of its content."""
    p = kept(payloads(spark, sf_dir))
    root = f"{shared_folder(p)}/{uuid4().hex}"
    for part in (p.where("bundle_id % 2 = 0"), p, p):
        outputs.publish_bundles(part, root)
    return outputs.verify_published(spark, root)


#: Most bytes of a record here, so that some are too large.
RECORD_BYTES = 1100


def record_parts(spark, sf_dir) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Heads of records for each order, and their facts, findings and warnings from line items."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    source = lambda s: F.struct(F.sha2(F.concat(k.cast("string"), F.lit(s)), 256).alias("sha256"), (k % 100).alias("size_bytes"))
    heads = o.select(
        k.alias("pair_id"), F.lit("1.0").alias("schema_version"), F.struct(F.lit("draft").alias("assurance"), F.sha2(k.cast("string"), 256).alias("canonical_sha256")).alias("frozen_policy"),
        F.struct(source("b").alias("baseline"), source("c").alias("candidate")).alias("sources"), F.struct((k % 2 == 0).alias("visual_available")).alias("environment"),
    )
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("ordinal")).agg(F.max("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))  # noqa: E741
    facts = l.select("pair_id", "ordinal", canon(fact_id=F.concat(F.lit("fact-"), F.col("part").cast("string")), kind=F.lit("line"), before=F.col("part"), after=F.when(F.col("flag") != "N", F.col("part") + 1)).alias("json"))
    findings = l.where("flag = 'R'").select("pair_id", "ordinal", canon(rule_id=F.concat(F.lit("rule."), F.col("ordinal").cast("string")), outcome=F.lit("review")).alias("json"))
    warnings = l.where("flag = 'A' AND part % 3 = 0").select("pair_id", "ordinal", F.lit('"evidence incomplete"').alias("json"))
    return heads, {"neutral_facts": facts, "raw_verdict": findings, "warnings": warnings}


@query(f"""WITH l AS (SELECT l_orderkey AS pair_id, l_linenumber AS ordinal, max(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
f AS (SELECT pair_id, string_agg('{{"after":' || CASE WHEN flag <> 'N' THEN (part + 1)::VARCHAR ELSE 'null' END || ',"before":' || part || ',"fact_id":"fact-' || part || '","kind":"line"}}', ',' ORDER BY ordinal) AS facts,
  string_agg(CASE WHEN flag = 'R' THEN '{{"outcome":"review","rule_id":"rule.' || ordinal || '"}}' END, ',' ORDER BY ordinal) AS found, string_agg(CASE WHEN flag = 'A' AND part % 3 = 0 THEN '"evidence incomplete"' END, ',' ORDER BY ordinal) AS warned FROM l GROUP BY 1),
r AS (SELECT o_orderkey AS pair_id, '{{"environment":{{"visual_available":' || (o_orderkey % 2 = 0) || '}},"frozen_policy":{{"assurance":"draft","canonical_sha256":"' || sha256(o_orderkey::VARCHAR) || '"}},"neutral_facts":[' || coalesce(facts, '') || '],"raw_verdict":[' || coalesce(found, '')
  || '],"schema_version":"1.0","sources":{{"baseline":{{"sha256":"' || sha256(o_orderkey || 'b') || '","size_bytes":' || (o_orderkey % 100) || '}},"candidate":{{"sha256":"' || sha256(o_orderkey || 'c') || '","size_bytes":' || (o_orderkey % 100) || '}}}},"warnings":[' || coalesce(warned, '') || ']}}' AS record
  FROM orders LEFT JOIN f ON f.pair_id = o_orderkey)
SELECT pair_id, strlen(record) AS size_bytes, CASE WHEN strlen(record) <= {RECORD_BYTES} THEN sha256(record) END AS digest, CASE WHEN strlen(record) > {RECORD_BYTES} THEN 'oversize' END AS error FROM r""")
def src_verification_records(spark, sf_dir):
    """SRC-09: records put together from four tables, or the error of those too large."""
    r = outputs.verification_records(*record_parts(spark, sf_dir), RECORD_BYTES)
    return r.select("pair_id", "size_bytes", F.sha2("record", 256).alias("digest"), "error")


_KEY = ["source", "contract_id", "format", "operator"]


def _results(spark, sf_dir) -> DataFrame:
    return _cases(spark, sf_dir).select(*_KEY, "expectation", "text_verdict", "rule_ids", "chars", "error")


@query(f"""WITH {CASE_SQL}, j AS (SELECT *, '{{"chars":' || chars || ',"contract_id":' || contract_id || ',"error":' || CASE WHEN error IS NULL THEN 'null' ELSE '"' || error || '"' END || ',"expectation":"' || expectation || '","format":"' || format || '","operator":"' || operator
  || '","rule_ids":["rule.' || lower(o_orderstatus) || '","rule.any"],"source":"' || source || '","text_verdict":"' || text_verdict || '"}}' AS line FROM cases)
SELECT row_number() OVER (ORDER BY source, contract_id, format, operator, line) AS line_no, line FROM j""")
def src_result_lines(spark, sf_dir):
    """SRC-06: a numbered line for each case, in the order of the key."""
    return outputs.result_lines(_results(spark, sf_dir), _KEY)


GROUPS = {"money_change": "value", "party_change": "party", "modal_swap": "wording"}
_RATE = "CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} END"
_WILSON = "({0} / {1} + 1.96 * 1.96 / (2 * {1})) / (1 + 1.96 * 1.96 / {1}) {2} 1.96 * sqrt({0} / {1} * (1 - {0} / {1}) / {1} + 1.96 * 1.96 / (4 * {1} * {1})) / (1 + 1.96 * 1.96 / {1})"


def _shown(n: str, total: str) -> str:
    lo, hi = (f"CASE WHEN {total} = 0 THEN 0 ELSE {w} END" for w in (f"greatest(0, {_WILSON.format(n, total, '-')})", f"least(1, {_WILSON.format(n, total, '+')})"))
    pct = lambda x: f"printf('%.2f', 100 * ({x})::DOUBLE) || '%'"
    return f"{pct(_RATE.format(n, total))} || ' (' || {pct(lo)} || '–' || {pct(hi)} || ')'"


@query(f"""WITH {CASE_SQL}, b AS (SELECT * FROM cases WHERE expectation = 'block' AND error IS NULL), a AS (SELECT *, text_verdict = 'pass' AND error IS NULL AS ok FROM cases WHERE expectation = 'accept'),
o AS (SELECT operator, count(*) FILTER (text_verdict = 'pass') AS n, count(*) AS t, count(*) FILTER (text_verdict = 'fail') AS f, count(*) FILTER (text_verdict = 'review') AS r FROM b GROUP BY 1),
m AS (SELECT format, count(*) FILTER (text_verdict = 'pass') AS n, count(*) AS t FROM b GROUP BY 1), w AS (SELECT count(*) FILTER (text_verdict = 'pass') AS n, count(*) AS t FROM b),
x AS (SELECT count(*) FILTER (ok) AS n, count(*) AS t FROM a), u AS (SELECT unnest(CASE WHEN error IS NULL THEN ['rule.' || lower(o_orderstatus), 'rule.any'] ELSE ['runner-error'] END) AS rule FROM a WHERE NOT ok), q AS (SELECT rule, count(*) AS n FROM u GROUP BY 1),
k AS (SELECT d.b, d.i, count(ok) FILTER (ok) AS n, count(ok) AS t FROM (VALUES ('<1k', 0), ('1-2k', 1), ('2-5k', 2), ('>5k', 3)) d(b, i) LEFT JOIN a ON d.b = CASE WHEN chars < 1000 THEN '<1k' WHEN chars < 2000 THEN '1-2k' WHEN chars < 5000 THEN '2-5k' ELSE '>5k' END GROUP BY 1, 2),
l(s, i, line) AS (
  SELECT 0, '0', '# Evaluation: orders' UNION ALL SELECT 0, '1', '- Cases: ' || count(*) || '; errors: ' || count(error) FROM cases
  UNION ALL SELECT 1, '', '**False passes: ' || n || '/' || t || ' — ' || {_shown('n', 't')} || '**' FROM w UNION ALL SELECT 2, '', '**Authorized edits accepted: ' || n || '/' || t || ' — ' || {_shown('n', 't')} || '**' FROM x
  UNION ALL SELECT 3, i, v FROM (VALUES ('0', '## False passes by operator'), ('1', '| Operator | Group | False passes | Rate (95% CI) | Blocked FAIL | Blocked REVIEW |'), ('2', '|---|---|---|---|---|---|')) h(i, v)
  UNION ALL SELECT 4, operator, '| ' || operator || ' | ' || CASE operator WHEN 'money_change' THEN 'value' WHEN 'party_change' THEN 'party' WHEN 'modal_swap' THEN 'wording' ELSE 'unknown' END || ' | ' || n || '/' || t || ' | ' || {_shown('n', 't')} || ' | ' || f || ' | ' || r || ' |' FROM o
  UNION ALL SELECT 5, i, v FROM (VALUES ('0', '## False passes by format'), ('1', '| Format | False passes | Rate (95% CI) |'), ('2', '|---|---|---|')) h(i, v)
  UNION ALL SELECT 6, format, '| ' || format || ' | ' || n || '/' || t || ' | ' || {_shown('n', 't')} || ' |' FROM m
  UNION ALL SELECT 7, i, v FROM (VALUES ('0', '## Why authorized edits were blocked'), ('1', '| Rule | Cases |'), ('2', '|---|---|')) h(i, v)
  UNION ALL SELECT 8, lpad((1000000000 - n)::VARCHAR, 10, '0') || rule, '| ' || rule || ' | ' || n || ' |' FROM q
  UNION ALL SELECT 9, i, v FROM (VALUES ('0', '## Acceptance by edited-clause length'), ('1', '| Clause length | Accepted | Rate (95% CI) |'), ('2', '|---|---|---|')) h(i, v)
  UNION ALL SELECT 10, i::VARCHAR, '| ' || b || ' | ' || n || '/' || t || ' | ' || {_shown('n', 't')} || ' |' FROM k)
SELECT row_number() OVER (ORDER BY s, i, line) AS line_no, line FROM l""")
def src_report_lines(spark, sf_dir):
    """SRC-07: the report of the derived cases."""
    return outputs.report_lines(_cases(spark, sf_dir), "orders", GROUPS)
