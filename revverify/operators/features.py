"""Document features and protected regions: groups, merges, differences, what lies near or overlaps, and their findings.

Features are rows (pair_id, kind, fingerprint, cnt, details map); evidence are rows (pair_id, id, block_id, page, x0, y0, x1, y1, r_page, rx0, ry0, rx1, ry1), the last five of the
rendered page and null without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import norm, stable_id
from .rules import finding

# Metadata that says nothing about the business, and the target that protects each kind of region.
NON_BUSINESS = ("application", "appversion", "created", "creator", "creationdate", "lastmodifiedby", "modified", "moddate", "producer")
REGION_TARGET = {"header": "headers", "footer": "footers", "signature": "signatures", "seal": "seals", "attachment": "attachments"}
BOX = ("x0", "y0", "x1", "y1")


def valid_rect(rect: Column, page: Column | None = None) -> Column:
    """PRJ-11: the rectangle (x0, y0, x1, y1) if its numbers are finite and in order and its page is no negative one; else null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = finite(rect["x0"]) & finite(rect["y0"]) & finite(rect["x1"]) & finite(rect["y1"]) & (rect["x0"] <= rect["x1"]) & (rect["y0"] <= rect["y1"])
    return F.when(ok if page is None else ok & (page >= 0), rect)


def rect_expand(rect: Column, pad: Column) -> Column:
    """FN-22: the rectangle, wider by pad on each side."""
    return F.struct((rect["x0"] - pad).alias("x0"), (rect["y0"] - pad).alias("y0"), (rect["x1"] + pad).alias("x1"), (rect["y1"] + pad).alias("y1"))


def rect_contains(outer: Column, inner: Column) -> Column:
    """FN-22: the first holds all of the second."""
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def rect_overlap(a: Column, b: Column) -> Column:
    """FN-22: the open rectangles share a point."""
    return (F.greatest(a["x0"], b["x0"]) < F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) < F.least(a["y1"], b["y1"]))


def feature_group(features: DataFrame) -> DataFrame:
    """PRJ-07: grp (kind and its allowed details, in order) and relevance of features (kind, details map)."""

    def detail(key: str, pattern: str, most: int) -> Column:
        raw = F.try_element_at("details", F.lit(key))
        return F.when((F.length(raw) <= most) & norm(raw).rlike(f"^(?:{pattern})$"), F.concat(F.lit(key + "="), norm(raw)))

    kind, raw = F.col("kind"), F.try_element_at("details", F.lit("metadata_key"))
    quiet = (kind == "metadata") & (F.try_element_at("details", F.lit("business_relevance")) == "non_business") & (F.length(raw) <= 128) & norm(raw).isin(*NON_BUSINESS)
    relevance = F.when(F.coalesce(quiet, F.lit(False)), "non_business").otherwise("business")
    parts = (
        F.when(kind == "metadata", F.array(F.concat(F.lit("business_relevance="), relevance), detail("metadata_key", "[a-z][a-z0-9_.-]{0,127}", 128)))
        .when(kind == "external_link", F.array(detail("host_hash", "[0-9a-f]{64}", 64), detail("uri_scheme", "[a-z][a-z0-9+.-]{0,31}", 32)))
        .when(kind == "tracked_revision", F.array(detail("revision_type", "insertion|deletion", 9)))
        .when(kind == "hidden_text", F.array(detail("hidden_kind", r"(?:vanish|webhidden)(?:\+(?:vanish|webhidden))?", 32)))
    )
    return features.withColumn("grp", F.concat_ws("|", kind, F.coalesce(parts, F.array().cast("array<string>")))).withColumn("relevance", relevance)


def merge_features(features: DataFrame) -> DataFrame:
    """AGG-06: features of one id (pair_id, feature_id, kind, fingerprint, cnt) made one row with the sum of their counts."""
    return features.groupBy("pair_id", "feature_id").agg(F.min("kind").alias("kind"), F.min("fingerprint").alias("fingerprint"), F.sum("cnt").alias("cnt"))


def grouped_diff(before: DataFrame, after: DataFrame, group: list[str], fp: str, count: str | None = None) -> DataFrame:
    """SET-05, SET-06: what is left of both sides in each group after equal fingerprints have met, counting repeats: (group, before, after, index).

    One left on each side is one change; others are rows of their own with a running index. Counts are summed before anything is expanded.
    """
    n = F.col(count) if count else F.lit(1)
    side = lambda df, s: df.groupBy(*group, fp).agg((s * F.sum(n)).alias("n"))
    left = side(before, 1).unionByName(side(after, -1)).groupBy(*group, fp).agg(F.sum("n").alias("n")).where("n <> 0")
    per = W.Window.partitionBy(*group)
    gone, new = F.sum(F.greatest("n", F.lit(0))).over(per), F.sum(F.greatest(-F.col("n"), F.lit(0))).over(per)
    left = left.withColumn("gone", gone).withColumn("new", new)
    single = left.where("gone = 1 AND new = 1").groupBy(*group).agg(F.max(F.when(F.col("n") > 0, F.col(fp))).alias("before"), F.max(F.when(F.col("n") < 0, F.col(fp))).alias("after")).withColumn("index", F.lit(0))
    rest = left.where("NOT (gone = 1 AND new = 1)").select(*group, fp, (F.col("n") > 0).alias("was"), F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("k"))
    rest = rest.withColumn("index", (F.row_number().over(W.Window.partitionBy(*group, "was").orderBy(fp, "k")) - 1).cast("int"))
    return single.unionByName(rest.select(*group, F.when(F.col("was"), F.col(fp)).alias("before"), F.when(~F.col("was"), F.col(fp)).alias("after"), "index"))


def feature_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """SET-06, ORD-06: changes of features (pair_id, kind, grp, relevance, fingerprint, cnt) with stable ids."""
    d = grouped_diff(before, after, ["pair_id", "kind", "grp", "relevance"], "fingerprint", "cnt")
    return d.withColumn("change_id", stable_id("fact", F.col("pair_id").cast("string"), F.concat(F.lit("feature:"), "kind"), F.col("grp"), F.col("index").cast("string"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))))


def order_facts(facts: DataFrame) -> DataFrame:
    """ORD-06: each pair's fact ids in one sorted list, unresolved ones (kind) in another; the order for sinks."""
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("change_id"))))
    return facts.groupBy("pair_id").agg(ids(F.lit(True)).alias("facts"), ids(F.col("kind") == "unresolved").alias("unresolved"))


def near_features(regions: DataFrame, evidence: DataFrame, gap: float = 24.0) -> DataFrame:
    """JN-07: (pair_id, region_id, id) of regions (pair_id, region_id, block_id, page, box) and the images' evidence in their block, or on their page at most so far away in x and y."""
    e = evidence.select("pair_id", "id", F.col("block_id").alias("e_block"), F.col("page").alias("e_page"), *[F.col(c).alias("e_" + c) for c in BOX])
    by_block = regions.join(e.withColumnRenamed("e_block", "block_id"), ["pair_id", "block_id"]).select("pair_id", "region_id", "id")
    by_page = regions.join(e.withColumnRenamed("e_page", "page"), ["pair_id", "page"])
    far = lambda a, b: F.greatest(F.col(a + "0") - F.col(b + "1"), F.col(b + "0") - F.col(a + "1"), F.lit(0.0))
    by_page = by_page.where(F.col("x0").isNotNull() & F.col("e_x0").isNotNull() & (far("x", "e_x") <= gap) & (far("y", "e_y") <= gap)).select("pair_id", "region_id", "id")
    return by_block.union(by_page).distinct()


def _geometry(e: DataFrame, s: str) -> DataFrame:
    """Evidence with one page and box: the rendered ones where there are both, else the document's."""
    shown = F.col("r_page").isNotNull() & F.col("rx0").isNotNull()
    pick = lambda a, b: F.when(shown, F.col(a)).otherwise(F.col(b))
    return e.select("pair_id", F.col("id").alias("id" + s), F.col("block_id").alias("block" + s), pick("r_page", "page").alias("page" + s), *[pick("r" + c, c).alias(c + s) for c in BOX])


def evidence_intersects(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-08: (pair_id, id) of left evidence in the block of some right evidence, or overlapping it on a page: two equi-joins."""
    a, b = _geometry(left, "1"), _geometry(right, "2")
    by_block = a.join(b.select("pair_id", F.col("block2").alias("block1")).distinct(), ["pair_id", "block1"], "left_semi").select("pair_id", "id1")
    a_box, b = a.where("x01 IS NOT NULL"), b.where("x02 IS NOT NULL")
    on = (a_box["pair_id"] == b["pair_id"]) & (F.col("page1") == F.col("page2")) & (F.greatest("x01", "x02") < F.least("x11", "x12")) & (F.greatest("y01", "y02") < F.least("y11", "y12"))
    return by_block.union(a_box.join(b, on, "left_semi").select("pair_id", "id1")).distinct().withColumnRenamed("id1", "id")


def matching_features(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """JN-20: (pair_id, change_id, id) of the features (pair_id, kind, fingerprint, id) that a change speaks of, side by side."""
    side = lambda col, df: changes.select("pair_id", "change_id", "kind", F.col(col).alias("fingerprint")).join(df.select("pair_id", "kind", "fingerprint", "id"), ["pair_id", "kind", "fingerprint"]).select("pair_id", "change_id", "id")
    return side("before", before).unionByName(side("after", after)).distinct()


def protected_evidence(evidence: DataFrame, protect: DataFrame) -> DataFrame:
    """SET-10: distinct evidence of both documents (pair_id, target, ..) whose target is protected (pair_id, target)."""
    return evidence.join(protect.distinct(), ["pair_id", "target"], "left_semi").drop("target").distinct()


def protected_regions(changes: DataFrame, protect: DataFrame) -> DataFrame:
    """RUL-11: failing findings for changed regions (pair_id, kind, change_id) of protected kinds."""
    target = F.create_map(*[F.lit(x) for kv in REGION_TARGET.items() for x in kv])
    c = changes.withColumn("target", F.try_element_at(target, F.col("kind"))).join(protect.distinct(), ["pair_id", "target"], "left_semi")
    return c.select(*finding(F.concat(F.lit("protected."), "target"), "fail", F.concat(F.lit("region:"), "change_id")))


def feature_findings(changes: DataFrame, overlapping: DataFrame, policies: DataFrame) -> DataFrame:
    """RUL-12: findings of feature changes (pair_id, change_id, kind, relevance), those that overlap protected content (pair_id, change_id), and policies (pair_id, non_business_change).

    Overlap fails. Metadata of the business fails, other metadata goes by the policy, everything else is an approvable review.
    """
    c = changes.join(overlapping.distinct().withColumn("hit", F.lit(True)), ["pair_id", "change_id"], "left").join(policies.select("pair_id", "non_business_change"), "pair_id", "left")
    hit, meta = F.coalesce("hit", F.lit(False)), F.col("kind") == "metadata"
    outcome = F.when(hit | (meta & (F.col("relevance") == "business")), "fail").when(~meta | (F.col("non_business_change") == "review"), "review").otherwise("pass")
    c = c.withColumn("what", outcome).withColumn("rule", F.when(meta, "metadata").otherwise(F.concat(F.lit("feature."), "kind")))
    return c.select(*finding(F.col("rule"), F.col("what"), F.concat(F.lit("feature:"), "change_id"))).withColumn("approvable", F.col("outcome") == "review")


def boxes_by_page(evidence: DataFrame) -> DataFrame:
    """AGG-21: the sorted distinct boxes of each page (pair_id, page)."""
    g = _geometry(evidence, "").where("page IS NOT NULL AND x0 IS NOT NULL")
    return g.groupBy("pair_id", "page").agg(F.array_sort(F.collect_set(F.struct(*BOX))).alias("boxes"))


def crop_bounds(regions: DataFrame, margin: int = 12) -> DataFrame:
    """PRJ-09: pixel bounds of regions (box, image_width, image_height, doc_width, doc_height): scaled, a margin wider, within the image. Without document sizes the scale is 1."""
    sx, sy = F.coalesce(F.try_divide("image_width", "doc_width"), F.lit(1.0)), F.coalesce(F.try_divide("image_height", "doc_height"), F.lit(1.0))
    low = lambda c, s: F.greatest(F.lit(0), F.floor(F.col(c) * s) - margin).cast("int")
    high = lambda c, s, most: F.least(F.col(most), F.ceil(F.col(c) * s) + margin).cast("int")
    return regions.withColumns({"px0": low("x0", sx), "py0": low("y0", sy), "px1": high("x1", sx, "image_width"), "py1": high("y1", sy, "image_height")})


def to_doc_coords(regions: DataFrame) -> DataFrame:
    """PRJ-10: regions array in pixels (with image_width, image_height, and both pages' widths and heights) in document coordinates; null for sizes that are not positive."""
    sx, sy = (F.greatest(f"before_{c}", f"after_{c}") / F.nullif(F.col(f"image_{c}"), F.lit(0)) for c in ("width", "height"))
    scale = F.transform("regions", lambda r: F.struct((r["x0"] * sx).alias("x0"), (r["y0"] * sy).alias("y0"), (r["x1"] * sx).alias("x1"), (r["y1"] * sy).alias("y1")))
    return regions.withColumn("regions", F.when((sx > 0) & (sy > 0), scale))


def visual_availability(pairs: DataFrame) -> DataFrame:
    """RUL-14: a finding for each pair (pair_id, available, on_unavailable) without a rendered view, of the policy's outcome."""
    p = pairs.where(~F.coalesce("available", F.lit(False)))
    return p.select(*finding("visual.unavailable", F.col("on_unavailable"), F.lit("visual:unavailable"))).withColumn("approvable", F.col("outcome") == "review")


def page_findings(changes: DataFrame) -> DataFrame:
    """RUL-15, RUL-16: findings of page changes (pair_id, change_id, before_page, after_page, ratio, regions, pagination_reflow): a deleted page fails, unpaired or moved ones go by the policy, a change without regions is a review."""
    b, a = F.col("before_page"), F.col("after_page")
    rule = F.when(b.isNotNull() & a.isNull(), "visual.page-deletion").when(~b.eqNullSafe(a) | b.isNull(), "visual.pagination-reflow").when((F.size("regions") == 0) & (F.col("ratio") > 0), "visual.outside-envelope")
    c = changes.withColumn("rule", rule).where("rule IS NOT NULL").withColumn("what", F.when(F.col("rule") == "visual.page-deletion", "fail").when(F.col("rule") == "visual.pagination-reflow", F.col("pagination_reflow")).otherwise("review"))
    return c.select(*finding(F.col("rule"), F.col("what"), F.concat_ws(":", F.lit("visual"), F.coalesce(b.cast("string"), F.lit("-")), F.coalesce(a.cast("string"), F.lit("-")), "change_id"))).withColumn("approvable", F.col("outcome") == "review")
