"""Edit policies: strict load, semantic checks against the baseline, simulated edits, drafts, sealing, binding.

Policies (pair_id, policy_id, baseline_sha256, format, protect, plugins) have rules (pair_id, rule_id, kind expect or allow, label, heading, path, anchor, fingerprint, occurrences,
op_occurrences, min_similarity, min_margin, before, after, kinds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_occ, find_spans, fp, normalized
from ..plans.materialize import kept
from .selectors import candidate_status, resolve_candidate, resolve_exact

MOST_RULES, MOST_BYTES = 100, 1 << 20
# What a policy may state.
TARGETS = ("parties", "money", "currency", "dates", "durations", "percentages", "headers", "footers", "signatures", "seals", "attachments")
FIELDS = ("schema_version", "profile", "profile_version", "baseline", "expect", "allow", "protect", "visual", "metadata", "evidence", "required_plugins")
DEFAULTS = {"pagination_reflow": "review", "on_unavailable": "review", "padding": "6.0", "non_business_change": "review", "evidence_mode": "minimal"}

_RULE = "struct<id:string,selector:struct<clause_label:string,heading:string,ancestor_path:array<string>,anchor:string,baseline_fingerprint:string,occurrences:int,min_similarity:double,min_margin:double>,operation:struct<before:string,after:string,occurrences:int>,kinds:array<string>>"
SCHEMA = f"schema_version string, profile string, baseline struct<sha256:string,format:string>, expect array<{_RULE}>, allow array<{_RULE}>, protect array<string>, required_plugins map<string,struct<allow_network:boolean,allow_model:boolean>>"


def load_policies(raw: DataFrame) -> DataFrame:
    """SRC-10: policies of JSON texts (pair_id, json), with reject_reason, null for those that load: too-large, not-json, unknown-field, repeated-field, bad-version, bad-baseline, too-many-rules, bad-target."""
    j = F.col("json")
    keys = F.json_object_keys(j)
    p = raw.withColumn("keys", F.when(F.octet_length(j) <= MOST_BYTES, keys)).withColumn("p", F.from_json(j, SCHEMA, {"mode": "PERMISSIVE"}))
    b = F.col("p.baseline")
    reason = (
        F.when(j.isNull() | (F.octet_length(j) > MOST_BYTES), "too-large").when(F.col("keys").isNull(), "not-json").when(F.size(F.array_distinct("keys")) < F.size("keys"), "repeated-field")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) > 0, "unknown-field").when((F.col("p.schema_version") != "1.0") | (F.col("p.profile") != "contract-safe"), "bad-version")
        .when(~F.coalesce(b["sha256"].rlike("^[0-9a-f]{64}$") & b["format"].isin("pdf", "docx"), F.lit(False)), "bad-baseline")
        .when((F.size("p.expect") > MOST_RULES) | (F.size("p.allow") > MOST_RULES), "too-many-rules").when(F.size(F.array_except("p.protect", F.array(*map(F.lit, TARGETS)))) > 0, "bad-target")
    )
    return p.select("pair_id", "json", "p", reason.alias("reject_reason"))


def rules_of(policies: DataFrame) -> DataFrame:
    """The rules of loaded policies (pair_id, p) as a table; those that allow have ids by their place."""
    p = policies.where("reject_reason IS NULL") if "reject_reason" in policies.columns else policies
    none = F.array().cast(f"array<{_RULE}>")
    tag = lambda c, kind: F.transform(F.coalesce(c, none), lambda r, i: F.struct(F.lit(kind).alias("kind"), F.coalesce(r["id"], F.concat(F.lit("allow-"), i.cast("string"))).alias("rule_id"), r.alias("r")))
    x = p.select("pair_id", F.explode(F.concat(tag(F.col("p.expect"), "expect"), tag(F.col("p.allow"), "allow"))).alias("x")).select("pair_id", "x.kind", "x.rule_id", F.col("x.r").alias("r"))
    s, o = F.col("r.selector"), F.col("r.operation")
    return x.select(
        "pair_id", "rule_id", "kind", s["clause_label"].alias("label"), s["heading"].alias("heading"), F.coalesce(s["ancestor_path"], F.array().cast("array<string>")).alias("path"), s["anchor"].alias("anchor"), F.coalesce(s["baseline_fingerprint"], F.lit("")).alias("fingerprint"),
        F.coalesce(s["occurrences"], F.lit(1)).alias("occurrences"), F.coalesce(o["occurrences"], F.lit(1)).alias("op_occurrences"), F.coalesce(s["min_similarity"], F.lit(0.92)).alias("min_similarity"), F.coalesce(s["min_margin"], F.lit(0.05)).alias("min_margin"),
        o["before"].alias("before"), o["after"].alias("after"), F.col("r.kinds").alias("kinds"),
    )


def _errors(df: DataFrame, *tests: tuple[str, Column]) -> DataFrame:
    """(pair_id, rule_id, error): a row for each test that a rule fails."""
    failed = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in tests]), lambda x: x.isNotNull())
    return df.select("pair_id", "rule_id", F.explode(failed).alias("error"))


def check_policy(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL-01: errors (pair_id, rule_id or null, error) of what policies say by themselves."""
    expect = rules.where("kind = 'expect'")
    own = _errors(
        expect, ("fingerprint-missing", F.coalesce("fingerprint", F.lit("")) == ""), ("no-change", normalized(F.col("before")).eqNullSafe(normalized(F.col("after"))) & F.col("before").eqNullSafe(F.col("after"))), ("occurrence-mismatch", F.col("op_occurrences") != F.col("occurrences")),
        ("bad-rule-id", ~F.col("rule_id").rlike("^[a-z][a-z0-9-]{0,63}$")),
    )
    twice = expect.groupBy("pair_id", "rule_id").count().where("count > 1").select("pair_id", "rule_id", F.lit("repeated-rule-id").alias("error"))
    n = rules.groupBy("pair_id").agg(F.count_if(F.col("kind") == "expect").alias("n"), F.count_if(F.col("kind") == "allow").alias("m"))
    none = F.lit(None).cast("string")
    p = policies.join(n, "pair_id", "left")
    whole = p.withColumn("rule_id", none)
    plugin = F.exists("plugins", lambda x: x["allow_network"] | x["allow_model"])
    whole = _errors(whole, ("no-expected-rule", F.coalesce("n", F.lit(0)) == 0), ("too-many-rules", (F.col("n") > MOST_RULES) | (F.col("m") > MOST_RULES)), ("plugin", plugin))
    return own.unionByName(twice).unionByName(whole)


def check_rules(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """RUL-02: errors of rules against the baseline: the selector must find one clause, of the stated fingerprint, and the edit be counted and unambiguous in it."""
    r = resolve_exact(rules, clauses)
    lost = r.where("status <> 'unique'").select("pair_id", "rule_id", F.lit("selector-not-unique").alias("error"))
    found = r.where("status = 'unique' AND kind = 'expect'").join(clauses.select("pair_id", "clause_no", F.col("text").alias("c_text"), F.col("fp").alias("c_fp")), ["pair_id", "clause_no"])
    n = F.col("op_occurrences")
    same = count_occ(F.col("c_text"), F.col("before")) == n
    after = count_occ(F.replace(F.col("c_text"), F.col("before"), F.col("after")), F.col("after"))
    return lost.unionByName(_errors(found, ("fingerprint-mismatch", F.col("fingerprint") != F.col("c_fp")), ("occurrence-mismatch", ~same), ("occurrence-ambiguity", same & (after != n))))


def overlaps(spans: Column) -> Column:
    """WIN-07: true when some span (start, end) of an array begins before an earlier one, by start, ends."""
    s = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.exists(F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: b["start"] < a["end"]), lambda x: F.coalesce(x, F.lit(False)))


def spliced(text: Column, edits: Column) -> Column:
    """The text with all edits (start, end, after), disjoint and from 0, put in: a fold over the edits in order."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, e: F.struct(e["end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, e["start"] - s["at"]), e["after"]).alias("out"))
    return F.aggregate(F.array_sort(edits), none, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def edits_of(rules: DataFrame, text: str, key: str) -> DataFrame:
    """(pair_id, key, edits): all places of the rules' before texts in their clause's text, with what comes there."""
    spans = F.transform(find_spans(F.col(text), F.col("before")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.col("after").alias("after")))
    return rules.groupBy("pair_id", key).agg(F.flatten(F.collect_list(spans)).alias("edits"))


def check_postedit(rules: DataFrame, clauses: DataFrame, method: str = "ratio") -> DataFrame:
    """RUL-03: errors of a simulated edit: all rules of a clause applied at once must not overlap, and each selector must still find its clause."""
    r = resolve_exact(rules.where("kind = 'expect'"), clauses).where("status = 'unique'")
    with_text = r.join(clauses.select("pair_id", "clause_no", F.col("text").alias("c_text")), ["pair_id", "clause_no"])
    e = edits_of(with_text, "c_text", "clause_no").withColumn("clash", overlaps(F.col("edits")))
    clash = r.join(e.where("clash"), ["pair_id", "clause_no"], "left_semi").select("pair_id", "rule_id", F.lit("overlap").alias("error"))
    new = clauses.join(e, ["pair_id", "clause_no"], "left").withColumn("text", F.when(F.col("edits").isNotNull() & ~F.col("clash"), spliced(F.col("text"), F.col("edits"))).otherwise(F.col("text")))
    new = new.withColumn("norm", normalized(F.col("text"))).withColumn("fp", fp(F.col("norm"))).drop("edits", "clash")
    best = candidate_status(resolve_candidate(r.select(*rules.columns), new, method)).where("status = 'high_confidence'").select("pair_id", "rule_id", F.col("clause_no").alias("found"))
    lost = r.join(best, ["pair_id", "rule_id"], "left").where("found IS NULL OR found <> clause_no").select("pair_id", "rule_id", F.lit("not-found-after-edit").alias("error"))
    return clash.unionByName(lost)


def draft_policies(selectors: DataFrame, clauses: DataFrame) -> DataFrame:
    """RUL-04: a rule for each selector (pair_id, rule_id, label, heading, path, anchor, occurrences, before, after) that stands for one clause, sealed with the clause's own label, heading, path and fingerprint, and fit to be applied."""
    rules = selectors.select(
        "pair_id", "rule_id", F.lit("expect").alias("kind"), "label", "heading", "path", "anchor", F.lit("").alias("fingerprint"), "occurrences", F.col("occurrences").alias("op_occurrences"), F.lit(0.92).alias("min_similarity"), F.lit(0.05).alias("min_margin"), "before", "after", F.lit(None).cast("array<string>").alias("kinds")
    )
    found = resolve_exact(rules, clauses).where("status = 'unique'").drop("status", "label", "heading", "path", "fingerprint")
    own = clauses.select("pair_id", "clause_no", "label", "heading", F.col("ancestor_path").alias("path"), F.col("fp").alias("fingerprint"))
    d = kept(found.join(own, ["pair_id", "clause_no"]).select(*rules.columns).where("before <> after"))
    bad = check_rules(d, clauses).unionByName(check_postedit(d, clauses)).select("pair_id", "rule_id").distinct()
    return d.join(bad, ["pair_id", "rule_id"], "left_anti")


def rule_text(c: str = "") -> Column:
    """FN-08 in array form: a rule's parts as a JSON list in a fixed order."""
    parts = [F.col("rule_id"), F.col("kind"), F.col("label"), F.col("heading"), F.to_json("path"), F.col("anchor"), F.col("fingerprint"), F.col("occurrences").cast("string"), F.col("before"), F.col("after"), F.coalesce(F.to_json(F.array_sort("kinds")), F.lit("[]"))]
    return F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts]))


def freeze(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL-05: policy_sha256 of each policy: digest of its baseline, format, sorted targets and rules in order of their ids."""
    r = rules.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", rule_text().alias("t")))).alias("r"))
    p = policies.join(r, "pair_id", "left")
    text = F.to_json(F.concat(F.array("baseline_sha256", "format"), F.array_sort("protect"), F.transform(F.coalesce("r", F.array().cast("array<struct<rule_id:string,t:string>>")), lambda x: x["t"])))
    return p.select("pair_id", "policy_id", F.sha2(text, 256).alias("policy_sha256"))


def bind_policies(policies: DataFrame, docs: DataFrame) -> DataFrame:
    """JN-17: each policy with its baseline document (doc_sha256, doc_format) by pair, and an error where there is none, or digest or format differ."""
    d = docs.select("pair_id", F.col("sha256").alias("doc_sha256"), F.col("format").alias("doc_format"))
    j = policies.join(d, "pair_id", "left")
    return j.withColumn("error", F.when(F.col("doc_sha256").isNull(), "no-baseline").when(F.col("doc_sha256") != F.col("baseline_sha256"), "baseline-digest").when(F.col("doc_format") != F.col("format"), "baseline-format"))


def policy_relaxations(policies: DataFrame) -> DataFrame:
    """PRJ-12: (pair_id, field, value, usual): settings (pagination_reflow, on_unavailable, padding, non_business_change, evidence_mode) that differ from the default policy's, and targets left unprotected."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value"), F.lit(v).alias("usual")) for k, v in sorted(DEFAULTS.items())])
    own = policies.select("pair_id", F.inline(F.filter(fields, lambda x: ~x["value"].eqNullSafe(x["usual"]))))
    gone = F.array_except(F.array(*map(F.lit, TARGETS)), "protect")
    return own.unionByName(policies.select("pair_id", F.lit("protect").alias("field"), F.lit("unprotected").alias("value"), F.explode(gone).alias("usual")))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
