"""The first viable edit of a contract: a value that stands once, in a clause that an anchor finds again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import anchor_words, count_occ, has_context, normalized, restated, shift_value
from ..plans.materialize import kept

# Kinds of values in the order in which they are tried, as their notation asks: a number with a unit of time, a percentage, an amount in dollars that does not go on.
_GROUPED, _PLAIN = r"\d{1,3}(?:,\d{3})+", r"\d+"
KINDS = (
    ("duration", rf"(?U)\b{_PLAIN} (?:days|months|years)\b"),
    ("percentage", rf"(?U)\b{_PLAIN}(?:\.{_PLAIN})?%"),
    ("money", rf"\$\s?(?:{_GROUPED}|{_PLAIN})(?![.,]?\d)"),
)
#: Reasons, those of a place in the order of the tests, and those of a contract.
PLACE_REASONS = ("restated", "target-repeats", "new-value-present", "no-anchor", "anchor-repeats", "clause-ambiguous")
NO_TARGET, NO_ANCHOR = "no-unique-target", "no-unique-anchor"


def edit_places(paragraphs: DataFrame, clauses: DataFrame, doc: str = "contract_id") -> DataFrame:
    """WIN-17, the search: values of each clause with their new value, anchor and the first test that rejects them.

    Rows (doc, clause_no, kind_no, pos, kind, before, after, anchor, label, heading, ancestor_path, rejected: one of PLACE_REASONS or null). Paragraphs (doc, ordinal, text),
    clauses (doc, clause_no, label, heading, ancestor_path, text, norm).
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("kind_no"), F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("values")) for i, (k, p) in enumerate(KINDS)])
    c = clauses.where(F.col("text").rlike(r"\d")).withColumn("k", F.explode(kinds))
    # A value that stands several times in its clause is rejected wherever it stands, so each is looked at once.
    c = c.withColumn("before", F.explode(F.array_distinct("k.values"))).withColumns({"kind_no": F.col("k.kind_no"), "kind": F.col("k.kind")}).drop("k")
    c = c.withColumn("pos", F.instr("text", F.col("before"))).withColumn("again", count_occ(F.col("text"), F.col("before")))
    c = c.withColumn("after", shift_value(F.col("before"), F.col("kind"))).withColumn("anchor", anchor_words(F.col("text"), F.col("before")))
    c = kept(c.withColumn("restated", restated(F.col("text"), F.col("before"))).withColumn("needle", normalized(F.col("anchor"))))
    # In the whole document: paragraph by paragraph, as no value holds a line break.
    wanted = c.where("NOT restated AND again = 1").select(doc, "before", "after").distinct()
    told = wanted.join(paragraphs.select(doc, F.col("text").alias("line")), doc)
    told = told.groupBy(doc, "before", "after").agg(F.sum(count_occ(F.col("line"), F.col("before"))).alias("total"), F.max(F.contains("line", F.col("after"))).alias("taken"))
    c = c.join(told, [doc, "before", "after"], "left")
    # Clauses that the selector would take for the same: equal label, heading and path, with the anchor exactly once.
    key = lambda df: df.withColumns({"k_label": normalized(F.col("label")), "k_heading": normalized(F.col("heading")), "k_path": F.to_json(F.transform("ancestor_path", lambda x: F.lower(F.btrim(F.regexp_replace(x, r"(?U)\s+", " ")))))})
    keys = [doc, "k_label", "k_heading", "k_path"]
    twins = key(clauses).select(*keys, F.col("norm").alias("twin"))
    open_ = key(c.where("total = 1 AND NOT taken AND anchor <> ''"))
    matches = open_.join(twins, keys).groupBy(doc, "clause_no", "before").agg(F.count_if(count_occ(F.col("twin"), F.col("needle")) == 1).alias("matches"))
    c = c.join(matches, [doc, "clause_no", "before"], "left")
    tests = (F.col("restated"), (F.col("again") != 1) | (F.col("total") != 1), F.col("taken"), F.col("anchor") == "", count_occ(F.col("norm"), F.col("needle")) != 1, F.col("matches") != 1)
    rejected = F.coalesce(*[F.when(t, r) for t, r in zip(tests, PLACE_REASONS, strict=True)])
    return c.select(doc, "clause_no", "kind_no", "pos", "kind", "before", "after", "anchor", "label", "heading", "ancestor_path", rejected.alias("rejected"))


def choose_edit(paragraphs: DataFrame, clauses: DataFrame, doc: str = "contract_id") -> DataFrame:
    """WIN-17: for each document its first viable edit by clause, kind and place, or the reason why it has none.

    Rows (doc, before, after, paragraph, label, heading, anchor, context: whether the anchor alone has words enough (FN-11), reason).
    """
    places = edit_places(paragraphs, clauses, doc)
    order = F.struct("clause_no", "kind_no", "pos")
    good = F.col("rejected").isNull()
    edit = F.struct("before", "after", "label", "heading", "anchor")
    unique = good | F.col("rejected").isin(*PLACE_REASONS[3:])
    best = places.groupBy(doc).agg(F.min_by(F.when(good, edit), F.when(good, order)).alias("edit"), F.max(unique).alias("unique"))
    every = paragraphs.select(doc).distinct().join(best, doc, "left")
    found = every.where("edit IS NOT NULL").select(doc, F.col("edit.before").alias("value"))
    at = paragraphs.join(found, doc).where(F.contains("text", F.col("value"))).groupBy(doc).agg(F.min("ordinal").alias("paragraph"))
    reason = F.when(F.col("edit").isNull(), F.when(F.col("unique"), NO_ANCHOR).otherwise(NO_TARGET))
    return every.join(at, doc, "left").select(doc, "edit.before", "edit.after", "paragraph", "edit.label", "edit.heading", "edit.anchor", has_context(F.col("edit.anchor")).alias("context"), reason.alias("reason"))


def first_places(places: DataFrame, doc: str = "contract_id") -> DataFrame:
    """Of the places of each document those up to its first viable one, in the order of the search, numbered from 1."""
    order = W.Window.partitionBy(doc).orderBy("clause_no", "kind_no", "pos")
    p = places.withColumn("place_no", F.row_number().over(order)).withColumn("done", F.coalesce(F.max(F.col("rejected").isNull()).over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(False)))
    return p.where("NOT done").drop("done")
