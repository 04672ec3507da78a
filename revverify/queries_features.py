"""Queries of features, regions and visual rules over features derived from events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import features as ft
from .operators import rules
from .registry import query
from .sources.corpus import table

KINDS = ("comment", "tracked_revision", "hidden_text", "external_link", "embedded_image", "metadata")
_KEYS = ("Creator", "producer", "title", "bad key!", "ModDate")


def _details() -> F.Column:
    k = F.col("event_id")
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (k % 5 + 1).cast("int"))
    return (
        F.when(F.col("kind") == "metadata", F.create_map(F.lit("metadata_key"), key, F.lit("business_relevance"), F.when(k % 2 == 0, "non_business").otherwise("business")))
        .when(F.col("kind") == "external_link", F.create_map(F.lit("host_hash"), F.when(k % 4 == 0, "x").otherwise(F.sha2((k % 3).cast("string"), 256)), F.lit("uri_scheme"), F.lit("HTTPS")))
        .when(F.col("kind") == "tracked_revision", F.create_map(F.lit("revision_type"), F.when(k % 3 == 0, "Insertion").when(k % 3 == 1, "deletion").otherwise("other")))
        .when(F.col("kind") == "hidden_text", F.create_map(F.lit("hidden_kind"), F.when(k % 2 == 0, "vanish+webHidden").otherwise("vanish")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def features(spark, sf_dir) -> DataFrame:
    """A feature for each event, its kind, details, count and place by the event's number."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id"), "event_id", kind.alias("kind"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("fingerprint"), (k % 3 + 1).alias("cnt"))
    return e.withColumn("details", _details())


FEATURE_SQL = """feat AS (SELECT user_id AS pair_id, event_id, ['comment', 'tracked_revision', 'hidden_text', 'external_link', 'embedded_image', 'metadata'][event_id % 6 + 1] AS kind, 'f' || (event_id % 5) AS fingerprint, event_id % 3 + 1 AS cnt FROM events),
grp AS (SELECT *, CASE WHEN kind = 'metadata' AND event_id % 2 = 0 AND event_id % 5 IN (0, 1, 4) THEN 'non_business' ELSE 'business' END AS relevance, kind || CASE kind
  WHEN 'metadata' THEN '|business_relevance=' || CASE WHEN event_id % 2 = 0 AND event_id % 5 IN (0, 1, 4) THEN 'non_business' ELSE 'business' END || ['|metadata_key=creator', '|metadata_key=producer', '|metadata_key=title', '', '|metadata_key=moddate'][event_id % 5 + 1]
  WHEN 'external_link' THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE '|host_hash=' || sha256((event_id % 3)::VARCHAR) END || '|uri_scheme=https'
  WHEN 'tracked_revision' THEN ['|revision_type=insertion', '|revision_type=deletion', ''][event_id % 3 + 1]
  WHEN 'hidden_text' THEN ['|hidden_kind=vanish+webhidden', '|hidden_kind=vanish'][event_id % 2 + 1] ELSE '' END AS grp FROM feat)"""


@query(f"WITH {FEATURE_SQL} SELECT event_id, grp, relevance FROM grp")
def prj_feature_groups(spark, sf_dir):
    """PRJ-07 over the derived features."""
    return ft.feature_group(features(spark, sf_dir)).select("event_id", "grp", "relevance")


@query(f"WITH {FEATURE_SQL} SELECT pair_id, kind || '-' || fingerprint AS feature_id, min(kind) AS kind, min(fingerprint) AS fingerprint, sum(cnt)::BIGINT AS cnt FROM feat GROUP BY 1, 2")
def agg_merge_features(spark, sf_dir):
    """AGG-06: features of one id in each user's document."""
    return ft.merge_features(features(spark, sf_dir).withColumn("feature_id", F.concat_ws("-", "kind", "fingerprint")))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = ft.feature_group(features(spark, sf_dir))
    return f.where("event_id % 7 > 0"), f.where("event_id % 9 > 0")


DIFF_SQL = f"""{FEATURE_SQL}, n AS (SELECT pair_id, kind, grp, relevance, fingerprint, sum(CASE WHEN event_id % 7 > 0 THEN cnt ELSE 0 END - CASE WHEN event_id % 9 > 0 THEN cnt ELSE 0 END)::BIGINT AS n FROM grp GROUP BY ALL HAVING n <> 0),
g AS (SELECT *, sum(greatest(n, 0)) OVER w AS gone, sum(greatest(-n, 0)) OVER w AS new FROM n WINDOW w AS (PARTITION BY pair_id, kind, grp, relevance)),
chg AS (SELECT pair_id, kind, grp, relevance, max(CASE WHEN n > 0 THEN fingerprint END) AS before, max(CASE WHEN n < 0 THEN fingerprint END) AS after, 0 AS "index" FROM g WHERE gone = 1 AND new = 1 GROUP BY ALL
UNION ALL SELECT pair_id, kind, grp, relevance, CASE WHEN n > 0 THEN fingerprint END, CASE WHEN n < 0 THEN fingerprint END, row_number() OVER (PARTITION BY pair_id, kind, grp, relevance, n > 0 ORDER BY fingerprint, k) - 1 FROM (SELECT *, unnest(range(1, abs(n)::BIGINT + 1)) AS k FROM g WHERE NOT (gone = 1 AND new = 1))),
ids AS (SELECT *, 'fact-' || left(sha256(concat_ws(chr(0), pair_id::VARCHAR, 'feature:' || kind, grp, "index"::VARCHAR, coalesce(before, ''), coalesce(after, ''))), 24) AS change_id FROM chg)"""


@query(f'WITH {DIFF_SQL} SELECT pair_id, kind, grp, relevance, before, after, "index"::INTEGER AS "index", change_id FROM ids')
def set_feature_diff(spark, sf_dir):
    """SET-05, SET-06, FN-09: feature changes between the earlier and the later document of each user."""
    return ft.feature_diff(*_sides(spark, sf_dir))


@query(f"WITH {DIFF_SQL} SELECT pair_id, len(list(change_id)) AS facts, sha256(string_agg(change_id, ',' ORDER BY change_id)) AS digest FROM ids GROUP BY 1")
def ord_facts(spark, sf_dir):
    """ORD-06: fact ids of each user in order."""
    o = ft.order_facts(ft.feature_diff(*_sides(spark, sf_dir)))
    return o.select("pair_id", F.size("facts").cast("long").alias("facts"), F.sha2(F.array_join("facts", ","), 256).alias("digest"))


def evidence(spark, sf_dir) -> DataFrame:
    """Evidence of each event: a block, a page and a box, every third rendered elsewhere, every eleventh without a box."""
    k = F.col("event_id")
    box = lambda v: F.when(k % 11 > 0, v.cast("double"))
    x, y = k * 37 % 500, k * 53 % 700
    shown = lambda v: F.when(k % 3 == 0, v.cast("double"))
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pair_id"), k.alias("id"), F.concat(F.lit("b"), (k % 97).cast("string")).alias("block_id"), (k % 4).cast("int").alias("page"), box(x).alias("x0"), box(y).alias("y0"), box(x + 30).alias("x1"), box(y + 12).alias("y1"),
        F.when(k % 3 == 0, (k % 5).cast("int")).alias("r_page"), shown(x + 5).alias("rx0"), shown(y + 5).alias("ry0"), shown(x + 35).alias("rx1"), shown(y + 17).alias("ry1"),
    )
    return e


EVIDENCE_SQL = """ev AS (SELECT user_id AS pair_id, event_id AS id, 'b' || (event_id % 97) AS block_id, (event_id % 4)::INTEGER AS page, CASE WHEN event_id % 11 > 0 THEN event_id * 37 % 500 END::DOUBLE AS x0, CASE WHEN event_id % 11 > 0 THEN event_id * 53 % 700 END::DOUBLE AS y0,
  CASE WHEN event_id % 11 > 0 THEN event_id * 37 % 500 + 30 END::DOUBLE AS x1, CASE WHEN event_id % 11 > 0 THEN event_id * 53 % 700 + 12 END::DOUBLE AS y1 FROM events),
geo AS (SELECT pair_id, id, block_id, CASE WHEN id % 3 = 0 THEN (id % 5)::INTEGER ELSE page END AS page, CASE WHEN id % 3 = 0 THEN id * 37 % 500 + 5.0 ELSE x0 END AS x0, CASE WHEN id % 3 = 0 THEN id * 53 % 700 + 5.0 ELSE y0 END AS y0,
  CASE WHEN id % 3 = 0 THEN id * 37 % 500 + 35.0 ELSE x1 END AS x1, CASE WHEN id % 3 = 0 THEN id * 53 % 700 + 17.0 ELSE y1 END AS y1 FROM ev)"""


@query(f"""WITH {EVIDENCE_SQL}, r AS (SELECT * FROM ev WHERE id % 10 = 0), e AS (SELECT * FROM ev WHERE id % 10 > 6)
SELECT DISTINCT r.pair_id, r.id AS region_id, e.id FROM r JOIN e ON r.pair_id = e.pair_id AND (r.block_id = e.block_id OR (r.page = e.page AND greatest(r.x0 - e.x1, e.x0 - r.x1, 0) <= 24 AND greatest(r.y0 - e.y1, e.y0 - r.y1, 0) <= 24 AND r.x0 IS NOT NULL AND e.x0 IS NOT NULL))""")
def jn_near_features(spark, sf_dir):
    """JN-07: images near each region, both kinds from the events' places."""
    e = evidence(spark, sf_dir)
    return ft.near_features(e.where("id % 10 = 0").withColumnRenamed("id", "region_id"), e.where("id % 10 > 6"))


@query(f"""WITH {EVIDENCE_SQL}, a AS (SELECT * FROM geo WHERE id % 10 < 5), b AS (SELECT * FROM geo WHERE id % 10 = 7)
SELECT DISTINCT a.pair_id, a.id FROM a JOIN b ON a.pair_id = b.pair_id AND (a.block_id = b.block_id OR (a.page = b.page AND greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1) AND a.x0 IS NOT NULL AND b.x0 IS NOT NULL))""")
def jn_evidence_intersects(spark, sf_dir):
    """JN-08, FN-22: evidence in a block with, or over, protected evidence."""
    e = evidence(spark, sf_dir)
    return ft.evidence_intersects(e.where("id % 10 < 5"), e.where("id % 10 = 7"))


@query(f"WITH {EVIDENCE_SQL} SELECT pair_id, page, count(*) AS boxes, min(x0) AS left, max(y1) AS low FROM (SELECT DISTINCT pair_id, page, x0, y0, x1, y1 FROM geo WHERE x0 IS NOT NULL) GROUP BY 1, 2")
def agg_boxes_by_page(spark, sf_dir):
    """AGG-21 over the events' places."""
    b = ft.boxes_by_page(evidence(spark, sf_dir))
    return b.select("pair_id", "page", F.size("boxes").cast("long").alias("boxes"), F.array_min(F.transform("boxes", lambda x: x["x0"])).alias("left"), F.array_max(F.transform("boxes", lambda x: x["y1"])).alias("low"))


def _ids(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    before, after = _sides(spark, sf_dir)
    changes = ft.feature_diff(before, after)
    named = lambda df: df.select("pair_id", "kind", "fingerprint", F.col("event_id").alias("id"))
    return changes, named(before), named(after)


MATCH_SQL = f"""{DIFF_SQL}, mt AS (SELECT DISTINCT i.pair_id, i.change_id, f.event_id AS id FROM ids i JOIN feat f ON f.pair_id = i.pair_id AND f.kind = i.kind AND ((f.fingerprint = i.before AND f.event_id % 7 > 0) OR (f.fingerprint = i.after AND f.event_id % 9 > 0)))"""


@query(f"WITH {MATCH_SQL} SELECT * FROM mt")
def jn_matching_features(spark, sf_dir):
    """JN-20: the features each change speaks of."""
    return ft.matching_features(*_ids(spark, sf_dir))


def _protected(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    e = evidence(spark, sf_dir).withColumn("target", F.when(k % 3 == 0, "money").when(k % 3 == 1, "seals").otherwise("headers"))
    protect = table(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id")).distinct().select("pair_id", F.explode(F.array(F.lit("money"), F.when(F.col("pair_id") % 2 == 0, "seals").otherwise("money"))).alias("target"))
    return ft.protected_evidence(e.where("id % 20 = 3").union(e.where("id % 20 IN (3, 9)")), protect)


_PROTECTED_SQL = "prot AS (SELECT * FROM ev WHERE id % 20 IN (3, 9) AND (id % 3 = 0 OR (id % 3 = 1 AND pair_id % 2 = 0)))"


@query(f"WITH {EVIDENCE_SQL}, {_PROTECTED_SQL} SELECT pair_id, id, block_id, page FROM prot")
def set_protected_evidence(spark, sf_dir):
    """SET-10: protected evidence of both documents, once each."""
    return _protected(spark, sf_dir).select("pair_id", "id", "block_id", "page")


@query(f"""WITH {MATCH_SQL}, {EVIDENCE_SQL}, {_PROTECTED_SQL}, pg AS (SELECT geo.* FROM geo JOIN prot USING (pair_id, id)),
hit AS (SELECT DISTINCT mt.pair_id, mt.change_id FROM mt JOIN geo a USING (pair_id, id) WHERE EXISTS (SELECT 1 FROM pg b WHERE a.pair_id = b.pair_id AND (a.block_id = b.block_id OR (a.page = b.page AND greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1) AND a.x0 IS NOT NULL AND b.x0 IS NOT NULL)))),
o AS (SELECT i.*, CASE WHEN hit.change_id IS NOT NULL OR (kind = 'metadata' AND relevance = 'business') THEN 'fail' WHEN kind <> 'metadata' OR i.pair_id % 3 > 0 THEN 'review' ELSE 'pass' END AS outcome FROM ids i LEFT JOIN hit ON hit.pair_id = i.pair_id AND hit.change_id = i.change_id)
SELECT pair_id, CASE WHEN kind = 'metadata' THEN 'metadata' ELSE 'feature.' || kind END AS rule_id, outcome, 'feature:' || change_id AS location, outcome = 'review' AS approvable FROM o""")
def rul_feature_findings(spark, sf_dir):
    """RUL-12 with JN-08, JN-20, SET-10: pass, review and fail of feature changes."""
    changes, before, after = _ids(spark, sf_dir)
    m = ft.matching_features(changes, before, after)
    own = evidence(spark, sf_dir).join(m, ["pair_id", "id"], "left_semi")
    over = ft.evidence_intersects(own, _protected(spark, sf_dir))
    hit = m.join(over, ["pair_id", "id"]).select("pair_id", "change_id")
    p = changes.select("pair_id").distinct().withColumn("non_business_change", F.when(F.col("pair_id") % 3 == 0, "ignore").otherwise("review"))
    return ft.feature_findings(changes, hit, p).select("pair_id", "rule_id", "outcome", "location", "approvable")


_REGION_KINDS = ("header", "footer", "signature", "seal", "attachment")


@query("""WITH r AS (SELECT l_orderkey AS pair_id, ['header', 'footer', 'signature', 'seal', 'attachment'][l_linenumber % 5 + 1] AS kind, sum(CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN l_linenumber < 6 THEN 1 ELSE 0 END) AS a, l_returnflag AS fp FROM lineitem GROUP BY ALL),
n AS (SELECT *, b - a AS n FROM r WHERE b <> a), g AS (SELECT *, sum(greatest(n, 0)) OVER w AS gone, sum(greatest(-n, 0)) OVER w AS new FROM n WINDOW w AS (PARTITION BY pair_id, kind)),
c AS (SELECT pair_id, kind, CASE WHEN gone = 1 AND new = 1 THEN 1 ELSE gone + new END AS n FROM g GROUP BY pair_id, kind, gone, new)
SELECT pair_id, 'protected.' || kind || 's' AS rule_id, n::BIGINT AS n FROM c WHERE kind <> 'footer' OR pair_id % 2 = 0""")
def rul_protected_regions(spark, sf_dir):
    """RUL-11, SET-05: changed regions of protected kinds; odd orders leave footers free."""
    kind = F.element_at(F.array(*map(F.lit, _REGION_KINDS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), "l_linenumber", kind.alias("kind"), F.col("l_returnflag").alias("fp"))  # noqa: E741
    d = ft.grouped_diff(l.where("l_linenumber > 2"), l.where("l_linenumber < 6"), ["pair_id", "kind"], "fp")
    d = d.withColumn("change_id", F.concat_ws(":", "kind", F.coalesce("before", F.lit("-")), F.coalesce("after", F.lit("-")), F.col("index").cast("string")))
    targets = F.filter(F.array(*map(F.lit, ft.REGION_TARGET.values())), lambda t: (t != "footers") | (F.col("pair_id") % 2 == 0))
    protect = l.select("pair_id").distinct().select("pair_id", F.explode(targets).alias("target"))
    return ft.protected_regions(d, protect).groupBy("pair_id", "rule_id").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x0, embedding[2]::DOUBLE * 100 AS y0, embedding[3]::DOUBLE * 100 AS x1, embedding[4]::DOUBLE * 100 AS y1 FROM embeddings)
SELECT vec_id, x0 <= x1 AND y0 <= y1 AND vec_id % 9 > 0 AS valid, greatest(0, floor(x0 * 1.5)::BIGINT - 12)::INTEGER AS px0, least(300, ceil(x1 * 1.5)::BIGINT + 12)::INTEGER AS px1, CASE WHEN vec_id % 5 > 0 THEN x1 * 3 END AS doc_x1,
x0 <= 10 AND y0 <= 10 AND x1 >= 0 AND y1 >= 0 AS holds, greatest(x0 - 2, 0) < least(x1 + 2, 10) AND greatest(y0 - 2, 0) < least(y1 + 2, 10) AS meets FROM p""")
def prj_rectangles(spark, sf_dir):
    """PRJ-09 to PRJ-11, FN-22 over rectangles read from vectors."""
    at = lambda i: (F.element_at("embedding", i).cast("double") * 100)
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[at(i + 1).alias(c) for i, c in enumerate(ft.BOX)]).withColumns({"image_width": F.lit(300), "image_height": F.lit(300), "doc_width": F.lit(200), "doc_height": F.lit(200)})
    e = ft.crop_bounds(e).withColumn("r", F.struct(*ft.BOX))
    whole = F.struct(*[F.lit(v).alias(c) for c, v in zip(ft.BOX, (0.0, 0.0, 10.0, 10.0), strict=True)])
    e = e.withColumn("valid", ft.valid_rect(F.col("r"), F.when(F.col("vec_id") % 9 == 0, -1).otherwise(0)).isNotNull()).withColumn("regions", F.array("r"))
    e = e.withColumn("holds", ft.rect_contains(F.col("r"), F.struct(F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1")))).withColumn("meets", ft.rect_overlap(ft.rect_expand(F.col("r"), F.lit(2.0)), whole))
    size = F.when(F.col("vec_id") % 5 > 0, 100).otherwise(0)
    e = ft.to_doc_coords(e.withColumns({"image_width": size, "image_height": size, "before_width": F.lit(300), "after_width": F.lit(200), "before_height": F.lit(300), "after_height": F.lit(300)}))
    return e.select("vec_id", "valid", "px0", "px1", F.col("regions")[0]["x1"].alias("doc_x1"), "holds", "meets")


@query("""SELECT o_orderkey AS pair_id, r AS rule_id, CASE r WHEN 'visual.page-deletion' THEN 'fail' WHEN 'visual.outside-envelope' THEN 'review' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'fail' ELSE 'review' END END AS outcome FROM (
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'visual.page-deletion' WHEN 1 THEN 'visual.pagination-reflow' WHEN 2 THEN 'visual.pagination-reflow' WHEN 3 THEN 'visual.outside-envelope' END AS r FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'visual.unavailable' END FROM orders) WHERE r IS NOT NULL""")
def rul_page_findings(spark, sf_dir):
    """RUL-14, RUL-15: pages that are gone, moved or changed without a place, and pairs without a view."""
    k = F.col("o_orderkey")
    reflow = F.when(k % 2 == 0, "fail").otherwise("review")
    o = table(spark, sf_dir, "orders")
    box = F.array(F.struct(*[F.lit(1.0).alias(c) for c in ft.BOX]))
    c = o.select(
        k.alias("pair_id"), F.lit("c").alias("change_id"), F.when(k % 6 != 1, 1).alias("before_page"), F.when(k % 6 == 0, None).when(k % 6 == 2, 2).otherwise(1).alias("after_page"), F.when(k % 6 == 5, 0.0).otherwise(0.5).alias("ratio"),
        F.when(k % 6 == 4, box).otherwise(F.slice(box, 1, 0)).alias("regions"), reflow.alias("pagination_reflow"),
    )
    v = o.select(k.alias("pair_id"), (k % 7 > 0).alias("available"), reflow.alias("on_unavailable"))
    return rules.union_findings(ft.page_findings(c), ft.visual_availability(v)).select("pair_id", "rule_id", "outcome")
