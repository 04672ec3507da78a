"""Rule evaluation: policies, protected values, regions, features and clause changes to findings and a verdict for each pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import count_occ, find_spans, fp, is_pure_replacement, normalized, stable_id
from ..plans.materialize import kept
from ..sources.corpus import spread
from .clauses import plain_clauses
from .diff import clause_changes, entity_diff, facts_equal, matched_sides, pair_clauses
from .entities import extract
from .policy import overlaps, spliced
from .selectors import resolved

SEVERITY = {"pass": 0, "review": 1, "fail": 2}
MOST_FINDINGS, MOST_LOCATIONS = 1000, 32
# The target that protects each kind of value.
TARGET_OF = {"party": "parties", "money": "money", "currency": "currency", "date": "dates", "duration": "durations", "percentage": "percentages"}


def severity(outcome: Column) -> Column:
    return F.when(outcome == "fail", 2).when(outcome == "review", 1).otherwise(0)


def finding(rule: str | Column, outcome: str | Column, location: Column, approvable: bool = False) -> list[Column]:
    rule_, out = (F.lit(x) if isinstance(x, str) else x for x in (rule, outcome))
    where = F.coalesce(location.cast("string"), F.lit(""))
    return [F.col("pair_id"), rule_.alias("rule_id"), out.alias("outcome"), where.alias("location"), F.lit(approvable).alias("approvable"), stable_id("finding", F.col("pair_id").cast("string"), rule_, where).alias("finding_id")]


def union_findings(*parts: DataFrame) -> DataFrame:
    """SET-08: all findings of all rules."""
    return reduce(DataFrame.unionByName, parts)


def order_findings(f: DataFrame) -> DataFrame:
    """ORD-01: phase of the rule, rule, location, id."""
    phases = ("integrity", "selector", "expected", "protected", "feature", "visual", "clause")
    phase = reduce(lambda a, p: a.when(F.startswith("rule_id", F.lit(p[1])), p[0]), enumerate(phases), F.when(F.lit(False), 0)).otherwise(len(phases))
    return f.withColumn("phase", phase).withColumn("n", F.row_number().over(W.Window.partitionBy("pair_id").orderBy("phase", "rule_id", "location", "finding_id")))


def cap_findings(f: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """ORD-02: more than 1,000 findings of a pair become the first 999 and one failing overflow finding."""
    o = order_findings(f).withColumn("total", F.count("*").over(W.Window.partitionBy("pair_id")))
    over = o.where(F.col("total") > most).select("pair_id").distinct().select(*finding("integrity.too-many-findings", "fail", F.lit("")))
    return o.where((F.col("total") <= most) | (F.col("n") < most)).select(*f.columns).union(over.select(*f.columns))


def stable_locations(locations: Column) -> Column:
    """ORD-05: distinct locations in order, the first 32."""
    return F.slice(F.array_sort(F.array_distinct(locations)), 1, MOST_LOCATIONS)


def combine(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-08: the worst outcome of each pair, pass without findings, and how many findings it has."""
    g = findings.groupBy("pair_id").agg(F.max(severity(F.col("outcome"))).alias("s"), F.count("*").alias("n"))
    s = F.coalesce("s", F.lit(0))
    return pairs.join(g, "pair_id", "left").select("pair_id", F.when(s == 2, "fail").when(s == 1, "review").otherwise("pass").alias("verdict"), F.coalesce("n", F.lit(0)).alias("findings"))


def text_verdict(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-09: the verdict without what the missing view alone found."""
    return combine(pairs, findings.where("rule_id <> 'visual.unavailable'"))


def integrity(pairs: DataFrame, given: DataFrame | None = None, recomputed: DataFrame | None = None) -> DataFrame:
    """RUL-06: failing findings of pairs (pair_id, base_ok, cand_ok, policy_error, base_sha256, cand_sha256, facts_base_sha256, facts_cand_sha256), and of facts (pair_id, fact) that differ when computed again."""
    tests = [
        ("baseline-document", ~F.coalesce("base_ok", F.lit(False))), ("candidate-document", ~F.coalesce("cand_ok", F.lit(False))), ("policy", F.col("policy_error").isNotNull()),
        ("facts-baseline", ~F.col("facts_base_sha256").eqNullSafe(F.col("base_sha256"))), ("facts-candidate", ~F.col("facts_cand_sha256").eqNullSafe(F.col("cand_sha256"))),
    ]
    failed = F.filter(F.array(*[F.when(bad, name) for name, bad in tests]), lambda x: x.isNotNull())
    out = pairs.select("pair_id", F.explode(failed).alias("what"))
    if given is not None:
        other = facts_equal(given, recomputed, ["fact"]).where("NOT equal").select("pair_id", F.lit("facts-content").alias("what"))
        out = out.unionByName(other)
    return out.select(*finding(F.concat(F.lit("integrity."), "what"), "fail", F.col("what")))


def guarded(integrity_findings: DataFrame, others: DataFrame) -> DataFrame:
    """RUL-06: a pair with an integrity finding has only those."""
    return integrity_findings.unionByName(others.join(integrity_findings.select("pair_id").distinct(), "pair_id", "left_anti").select(*integrity_findings.columns))


def selector_failures(r: DataFrame) -> DataFrame:
    """RUL-07: a failing finding for each rule whose clause is not found in the baseline, or else in the candidate (of resolved rules)."""
    kind = F.when(F.col("kind") == "expect", "expected").otherwise("allow")
    side = F.when(F.col("b").isNull(), "baseline").when(F.col("a").isNull(), "candidate")
    status = F.when(F.col("b").isNull(), F.col("b_status")).otherwise(F.col("a_status"))
    lost = r.withColumn("side", side).where("side IS NOT NULL")
    return lost.select(*finding(F.concat(F.lit("selector."), kind, F.lit("-"), "side"), "fail", F.concat_ws(":", kind, "rule_id", status)))


def expected_assessments(r: DataFrame, base: DataFrame, cand: DataFrame) -> DataFrame:
    """RUL-08, WIN-16: of expected rules found on both sides (pair_id, rule_id, b, a): applied, exact, and the edit's spans on both sides.

    A rule is counted when its clause holds the text before so many times, and the other the text after. The rules of one clause pair are exact together:
    their spans are disjoint on both sides, and all of them put into the baseline give the candidate.
    """
    e = r.where("kind = 'expect' AND b IS NOT NULL AND a IS NOT NULL")
    e = e.join(base.select("pair_id", F.col("clause_no").alias("b"), F.col("text").alias("text_b")), ["pair_id", "b"]).join(cand.select("pair_id", F.col("clause_no").alias("a"), F.col("text").alias("text_a")), ["pair_id", "a"])
    e = e.withColumn("before_spans", find_spans(F.col("text_b"), F.col("before"))).withColumn("after_spans", find_spans(F.col("text_a"), F.col("after")))
    counted = (F.size("before_spans") == F.col("op_occurrences")) & (F.size("after_spans") >= F.col("op_occurrences"))
    edits = F.transform("before_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.col("after").alias("after")))
    e = e.withColumn("counted", counted)
    g = e.groupBy("pair_id", "b", "a").agg(F.min("counted").alias("all_counted"), F.first("text_b").alias("text_b"), F.first("text_a").alias("text_a"), F.flatten(F.collect_list(edits)).alias("edits"), F.flatten(F.collect_list("after_spans")).alias("after_all"))
    same = normalized(spliced(F.col("text_b"), F.col("edits"))) == normalized(F.col("text_a"))
    g = g.select("pair_id", "b", "a", (F.col("all_counted") & ~overlaps(F.col("edits")) & ~overlaps(F.col("after_all")) & F.when(F.col("all_counted") & ~overlaps(F.col("edits")), same).otherwise(False)).alias("exact"))
    return e.join(g, ["pair_id", "b", "a"]).select("pair_id", "rule_id", "b", "a", "before_spans", "after_spans", (F.col("counted") & F.col("exact")).alias("applied"), "exact")


def expected_findings(assessed: DataFrame) -> DataFrame:
    """RUL-08: a passing finding for each applied rule, a failing one for the others (what is not proven fails)."""
    return assessed.select(*finding("expected.replacement", F.when(F.col("applied"), "pass").otherwise("fail"), F.concat(F.lit("expected:"), "rule_id")))


def allowed_changes(r: DataFrame) -> DataFrame:
    """RUL-09: the kinds of change allowed for each clause pair (pair_id, b, a, kinds)."""
    return r.where("kind = 'allow' AND b IS NOT NULL AND a IS NOT NULL").groupBy("pair_id", "b", "a").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def authorized_entities(changes: DataFrame, entities: DataFrame, texts: DataFrame, spans: DataFrame, side: str, value: str) -> DataFrame:
    """JN-05: changes (pair_id, change, <side>, kind, <value>) whose value on one side is authorized: the clause has just one entity of that kind and value, its text stands there once, within an authorized span (pair_id, <side>, start, end)."""
    one = entities.select("pair_id", side, "kind", F.col("value").alias(value), F.col("text").alias("e_text")).groupBy("pair_id", side, "kind", value).agg(F.count("*").alias("c"), F.min("e_text").alias("e_text")).where("c = 1")
    place = find_spans(F.col("text"), F.col("e_text"))
    x = changes.join(one, ["pair_id", side, "kind", value]).join(texts, ["pair_id", side]).withColumn("place", place).where(F.size("place") == 1)
    inside = x.join(spans, ["pair_id", side]).where("start <= place[0].start AND end >= place[0].end")
    return inside.select("pair_id", "change").distinct()


def protected_entities(changes: DataFrame, base: DataFrame, cand: DataFrame, eb: DataFrame, ea: DataFrame, assessed: DataFrame, protect: DataFrame) -> DataFrame:
    """RUL-10: failing findings for changed values (pair_id, b, a, kind, before, after) of protected kinds that no expected edit authorizes on both sides. protect: (pair_id, target)."""
    target = F.create_map(*[F.lit(x) for kv in TARGET_OF.items() for x in kv])
    c = changes.withColumn("target", F.try_element_at(target, F.col("kind"))).join(protect.select("pair_id", "target").distinct(), ["pair_id", "target"], "left_semi")
    c = kept(c.withColumn("change", stable_id("fact", F.col("pair_id").cast("string"), F.col("b").cast("string"), F.col("kind"), F.coalesce("before", F.lit("-")), F.coalesce("after", F.lit("-")))))
    span = lambda col, side: assessed.where("applied").select("pair_id", side, F.inline(col))
    text = lambda df, side: df.select("pair_id", F.col("clause_no").alias(side), "text")
    ok = authorized_entities(c, eb, text(base, "b"), span("before_spans", "b"), "b", "before").join(authorized_entities(c, ea, text(cand, "a"), span("after_spans", "a"), "a", "after"), ["pair_id", "change"])
    return c.join(ok, ["pair_id", "change"], "left_anti").select(*finding(F.concat(F.lit("protected."), "target"), "fail", F.concat(F.lit("entity:"), "change")))


def clause_findings(changes: DataFrame, assessed: DataFrame, allowed: DataFrame) -> DataFrame:
    """RUL-13: an unresolved clause fails; a pair whose expected rules are all exact is skipped; a change of an allowed kind is an approvable review; any other fails."""
    exact = assessed.groupBy("pair_id", "b", "a").agg(F.min("exact").alias("exact")).where("exact").select("pair_id", "b", "a")
    rest = changes.join(exact, ["pair_id", "b", "a"], "left_anti").join(allowed, ["pair_id", "b", "a"], "left")
    ok = F.coalesce(F.array_contains("kinds", F.col("change_kind")), F.lit(False))
    rest = rest.withColumnRenamed("kind", "change_kind").withColumn("ok", ok)
    where = F.concat_ws(":", "change_kind", F.coalesce("b", "a").cast("string"))
    review = rest.where("ok AND change_kind <> 'unresolved'").select(*finding("clause.allowed", "review", where, True))
    bad = rest.where("NOT ok OR change_kind = 'unresolved'").select(*finding(F.when(F.col("change_kind") == "unresolved", "clause.unresolved").otherwise("clause.unexplained"), "fail", where))
    return review.unionByName(bad)


def entities_of(clauses: DataFrame, some: DataFrame, side: str) -> DataFrame:
    """The entities of some of the clauses (pair_id, <side>). Their texts are few and small, and each takes long, so they are dealt over all cores."""
    texts = clauses.select("pair_id", F.col("clause_no").alias(side), "text").join(some, ["pair_id", side], "left_semi")
    return extract(spread(texts, "pair_id", side), ["pair_id", side])


def evaluate(base_paragraphs: DataFrame, cand_paragraphs: DataFrame, rules: DataFrame, protect: DataFrame, method: str = "ratio") -> tuple[DataFrame, DataFrame]:
    """RUL-17: findings and a verdict for each pair of two paragraph tables (pair_id, ordinal, text) under the pairs' rules and protected targets (pair_id, target)."""
    both = base_paragraphs.withColumn("side", F.lit(0)).unionByName(cand_paragraphs.withColumn("side", F.lit(1)))
    return evaluate_both(both, rules, protect, method, base_paragraphs.select("pair_id").distinct())


def evaluate_both(both: DataFrame, rules: DataFrame, protect: DataFrame, method: str = "ratio", ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """RUL-17 of both sides' paragraphs (pair_id, side, ordinal, text) in one table."""
    matched, base, cand, with_base = matched_sides(plain_clauses(both, ("pair_id", "side")), labels=rules.select("pair_id", "label"))
    base, cand = (kept(c.withColumn("norm", normalized(F.col("text"))).withColumn("fp", fp(F.col("norm")))) for c in (base, cand))
    pairs = matched[0].select("pair_id", "b", "a")
    r = kept(resolved(rules, base, cand, method))
    assessed = kept(expected_assessments(r, base, cand))
    # Only clauses whose texts differ can hold values that differ.
    said = lambda df, side: df.select("pair_id", F.col("clause_no").alias(side), F.unhex(F.sha2("text", 256)).alias("text_" + side))
    other = kept(pairs.join(said(base, "b"), ["pair_id", "b"]).join(said(cand, "a"), ["pair_id", "a"]).where("text_b <> text_a").select("pair_id", "b", "a"))
    eb, ea = (kept(entities_of(df, other.select("pair_id", side), side)) for df, side in ((base, "b"), (cand, "a")))
    values = entity_diff(eb, ea.join(other, ["pair_id", "a"]))
    values = values.join(other, ["pair_id", "b"])
    changes = clause_changes(base, cand, matched)
    found = union_findings(selector_failures(r), expected_findings(assessed), protected_entities(values, base, cand, eb, ea, assessed, protect), clause_findings(changes, assessed, allowed_changes(r)))
    found = kept(cap_findings(kept(found)))
    return found, combine(with_base if ids is None else ids, found)


def expected_edits(edits: DataFrame, base: DataFrame, cand: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """RUL-08 for edits without selectors: the clause that held the declared text, paired with its candidate, must be the baseline with just that edit: (pair_id, b, exact, places)."""
    pairs = pair_clauses(base, cand) if pairs is None else pairs
    b = base.select("pair_id", F.col("clause_no").alias("b"), F.col("text").alias("text_b"))
    a = cand.select("pair_id", F.col("clause_no").alias("a"), F.col("text").alias("text_a"))
    j = edits.select("pair_id", "before", "after").join(b, "pair_id").where(count_occ(F.col("text_b"), F.col("before")) == 1).join(pairs, ["pair_id", "b"], "left").join(a, ["pair_id", "a"], "left")
    exact = is_pure_replacement(F.col("text_b"), F.coalesce("text_a", F.lit("")), F.col("before"), F.col("after"), F.lit(1))
    return j.groupBy("pair_id").agg(F.min("b").alias("b"), F.min(exact).alias("exact"), F.count("*").alias("places"))


def verdicts(base_paragraphs: DataFrame, cand_paragraphs: DataFrame, edits: DataFrame, protect: tuple[str, ...] = tuple(TARGET_OF)) -> tuple[DataFrame, DataFrame]:
    """RUL-17 for declared edits (pair_id, before, after) without selectors: findings, and a verdict for each pair, of two paragraph tables (pair_id, ordinal, text)."""
    both = base_paragraphs.withColumn("side", F.lit(0)).unionByName(cand_paragraphs.withColumn("side", F.lit(1)))
    found, with_base = verdict_findings(both, edits, protect)
    return found, combine(base_paragraphs.select("pair_id").distinct() if "content_type" in base_paragraphs.columns else with_base, found)


def verdict_findings(both: DataFrame, edits: DataFrame, protect: tuple[str, ...] = tuple(TARGET_OF)) -> tuple[DataFrame, DataFrame]:
    """RUL-17 for declared edits of both sides' paragraphs (pair_id, side, ordinal, text) in one table: the findings, and the pairs that have a baseline."""
    matched, base, cand, with_base = matched_sides(plain_clauses(both, ("pair_id", "side")), edits)
    edits = edits.join(with_base, "pair_id", "left_semi")
    pairs = matched[0].select("pair_id", "b", "a")
    expected = kept(expected_edits(edits, base, cand, pairs))
    bad = edits.select("pair_id").distinct().join(expected, "pair_id", "left")
    bad = bad.where("exact IS NULL OR NOT exact OR places <> 1").select(*finding("expected.authorized", "fail", F.col("b")))
    done = expected.where("exact AND places = 1").select("pair_id", "b")
    # Only clauses that differ can hold values that differ.
    kept_pairs = kept(matched[0].where("NOT same_fp").select("pair_id", "b", "a").join(done, ["pair_id", "b"], "left_anti"))
    changes = clause_changes(base, cand, matched)
    clause = changes.join(done, ["pair_id", "b"], "left_anti").select(*finding("clause.unexplained", "fail", F.concat_ws(":", "kind", F.coalesce("b", "a").cast("string"))))
    eb = entities_of(base, kept_pairs.select("pair_id", "b"), "b")
    ea = entities_of(cand, kept_pairs.select("pair_id", "a"), "a").join(kept_pairs, ["pair_id", "a"])
    values = entity_diff(eb, ea).where(F.col("kind").isin(*protect))
    entity = values.select(*finding("protected.entity", "fail", F.concat_ws(":", F.col("b").cast("string"), "kind", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))))
    return cap_findings(kept(bad.union(clause).union(entity))), with_base
