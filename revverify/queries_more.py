"""Queries of block identity, admission, trust, pairing, order, coverage and paging, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import clauses, diff, events, grid, rules
from .plans.materialize import kept, shared_folder
from .queries import LOG_SQL, PAYLOAD_SQL, _payloads, whole_texts
from .registry import query
from .sources import corpus
from .sources.corpus import PARAGRAPHS_SQL, contract_paragraphs, table


def blocks(spark, sf_dir) -> DataFrame:
    """The contracts' paragraphs as blocks: every fifth a table, even contracts paged."""
    o = F.col("ordinal")
    p = contract_paragraphs(spark, sf_dir).select(F.col("contract_id").alias("doc_id"), "ordinal", "text")
    kind, form = F.when(o % 5 == 3, "table").otherwise("paragraph"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("docx")
    return p.withColumns({"content_type": kind, "format": form, "page_index": F.floor(o / 4).cast("int")})


@query(f"""WITH {PARAGRAPHS_SQL} SELECT contract_id AS doc_id, count(*) AS paragraphs, sha256(string_agg(ordinal || '|' || CASE WHEN ordinal % 3 = 1 THEN upper(text) ELSE text END, chr(10) ORDER BY ordinal)) AS digest
FROM para WHERE NOT (ordinal % 3 = 1 AND contract_id % 2 = 0) GROUP BY 1""")
def prj_visible_blocks(spark, sf_dir):
    """PRJ-01: every third block replaced by its visible text, which is blank in even contracts."""
    b = blocks(spark, sf_dir)
    shown = b.where("ordinal % 3 = 1").select("doc_id", "ordinal", F.when(F.col("doc_id") % 2 == 0, " \u00a0").otherwise(F.upper("text")).alias("visible"))
    return whole_texts(clauses.visible_blocks(b, shown).withColumnRenamed("doc_id", "contract_id")).withColumnRenamed("contract_id", "doc_id")


@query(f"""WITH {PARAGRAPHS_SQL} SELECT contract_id AS doc_id, sha256(string_agg(CASE WHEN contract_id % 2 = 0 THEN 'pdf:' || (ordinal // 4) || ':' || ordinal
  ELSE 'docx:' || ordinal || ':' || CASE WHEN ordinal % 5 = 3 THEN 'table' ELSE 'paragraph' END || ':' || sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) END, ',' ORDER BY ordinal)) AS ids FROM para GROUP BY 1""")
def prj_block_ids(spark, sf_dir):
    """PRJ-02: the identities of each document's blocks, as one digest."""
    b = clauses.block_ids(blocks(spark, sf_dir))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "block_id"))), lambda x: x["block_id"])
    return b.groupBy("doc_id").agg(F.sha2(F.array_join(ids, ","), 256).alias("ids"))


@query(f"WITH {PARAGRAPHS_SQL} SELECT contract_id AS doc_id, ordinal FROM para WHERE ordinal % 5 = 3")
def prj_table_refs(spark, sf_dir):
    """PRJ-06: the blocks that are tables."""
    return clauses.table_refs(blocks(spark, sf_dir))


@query("SELECT sha256(s_name || chr(10)) AS sha256, strlen(s_name)::BIGINT + 1 AS size_bytes, 'txt' AS format FROM supplier")
def src_describe_files(spark, sf_dir):
    """SRC-03: a text file for each supplier, described from its bytes."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = f"{shared_folder(s)}/{uuid4().hex}"
    s.repartition("s_suppkey").write.partitionBy("s_suppkey").text(path)
    return corpus.describe_files(spark, path).where("path NOT LIKE '%/_SUCCESS'").select("sha256", "size_bytes", "format")


@query("""WITH d AS (SELECT o_orderkey AS doc_id, ['docx', 'pdf', 'PDF', 'txt'][o_orderkey % 4 + 1] AS format, floor(o_totalprice)::BIGINT * 1000 AS size_bytes, o_orderkey % 700 AS page_count FROM orders)
SELECT doc_id, CASE WHEN format NOT IN ('docx', 'pdf') THEN 'unsupported-format' WHEN size_bytes > 104857600 THEN 'too-large' WHEN page_count > 500 THEN 'too-many-pages' END AS reject_reason FROM d""")
def src_admit(spark, sf_dir):
    """SRC-04: documents of each order, admitted or not."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, ("docx", "pdf", "PDF", "txt"))), (k % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "orders").select(k.alias("doc_id"), form.alias("format"), (F.floor("o_totalprice") * 1000).alias("size_bytes"), (k % 700).alias("page_count"))
    return corpus.admit(d).select("doc_id", "reject_reason")


@query("""WITH s AS (SELECT event_id, user_id % 50 AS i, 'f' || (event_id % 2) AS fp, ts FROM events), d AS (SELECT DISTINCT user_id % 50 AS i FROM events),
t AS (SELECT i, 'f0' AS fp, i % 3 <> 0 AS holds, i % 11 = 0 AS revoked, CASE WHEN i % 5 = 0 THEN TIMESTAMP '2024-01-10' END AS a, CASE WHEN i % 4 = 0 THEN TIMESTAMP '2024-01-20' END AS b, unnest(CASE WHEN i % 7 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM d)
SELECT s.event_id, count(t.i) = 1 AND coalesce(bool_or(holds AND NOT revoked AND (a IS NULL OR a <= ts) AND (b IS NULL OR ts <= b)), false) AS trusted FROM s LEFT JOIN t ON t.i = s.i AND t.fp = s.fp GROUP BY 1""")
def jn_currently_trusted(spark, sf_dir):
    """JN-10: signers of events, some without the role, revoked, out of time, of another key, or twice in the store."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("signer_id"), F.concat(F.lit("f"), (F.col("event_id") % 2).cast("string")).alias("signer_fp"), F.col("ts").cast("timestamp").alias("at"))
    i = F.col("identity_id")
    ids = e.select(F.col("signer_id").alias("identity_id")).distinct().withColumn("copy", F.explode(F.when(i % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    roles = F.when(i % 3 == 0, F.array(F.lit("archive"))).otherwise(F.array(F.lit("approver"), F.lit("archive")))
    day = lambda n, d: F.when(i % n == 0, F.lit(f"2024-01-{d}").cast("timestamp"))
    ids = ids.select("identity_id", F.lit("f0").alias("fp"), roles.alias("roles"), (i % 11 == 0).alias("revoked"), day(5, 10).alias("valid_from"), day(4, 20).alias("valid_until"))
    return events.currently_trusted(e, ids, "approver").select("event_id", "trusted")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS g, l_linenumber::INTEGER AS n, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
c AS (SELECT x.g, x.n AS b, y.n AS a, (x.p * 7 + y.p * 13 + x.n * y.n) % 100 AS s FROM l x JOIN l y USING (g)),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, b, a) AS k FROM c WHERE s >= 45),
r AS (SELECT DISTINCT g, 0::BIGINT AS k, []::INTEGER[] AS bs, []::INTEGER[] AS xs FROM k
  UNION ALL SELECT r.g, k.k, CASE WHEN list_contains(bs, b) OR list_contains(xs, a) THEN bs ELSE list_append(bs, b) END, CASE WHEN list_contains(bs, b) OR list_contains(xs, a) THEN xs ELSE list_append(xs, a) END FROM r JOIN k ON k.g = r.g AND k.k = r.k + 1)
SELECT g, unnest(bs) AS b, unnest(xs) AS a FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1)""")
def jn_greedy_pair(spark, sf_dir):
    """JN-12: the lines of each order paired with one another by a similarity with ties, from 0.45 on."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("int").alias("n")).agg(F.max("l_partkey").alias("p"))  # noqa: E741
    l = kept(l)  # noqa: E741
    c = l.select("g", F.col("n").alias("b"), F.col("p").alias("pb")).join(l.select("g", F.col("n").alias("a"), F.col("p").alias("pa")), "g")
    c = c.withColumn("similarity", ((F.col("pb") * 7 + F.col("pa") * 13 + F.col("b") * F.col("a")) % 100) / 100).where("similarity >= 0.45")
    return diff.greedy_pair(c.select("g", "b", "a", "similarity")).select("g", "b", "a")


@query("SELECT l_orderkey AS pair_id, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE l_partkey % 100 / 100.0 END::DOUBLE * l_quantity) / sum(l_quantity), 9) AS ratio FROM lineitem GROUP BY 1")
def agg_weighted_change(spark, sf_dir):
    """AGG-07: the pages of each order, those without partner counted whole."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey") % 100 / 100.0).alias("ratio"), F.col("l_quantity").alias("area"))
    return grid.weighted_change(p).select("pair_id", F.round("ratio", 9).alias("ratio"))


@query("""SELECT event_id // 4 AS pair_id, ['pass', 'review', 'fail'][coalesce(max(CASE WHEN event_id % 3 > 0 THEN CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END END), 0) + 1] AS verdict, count(*) FILTER (event_id % 3 > 0) AS findings FROM events GROUP BY 1""")
def agg_text_verdict(spark, sf_dir):
    """AGG-09: verdicts without what the missing view alone found."""
    e = table(spark, sf_dir, "events").withColumn("pair_id", F.floor(F.col("event_id") / 4))
    outcome = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "review").otherwise("pass")
    f = e.select(*rules.finding(F.when(F.col("event_id") % 3 == 0, "visual.unavailable").otherwise("clause.unexplained"), outcome, F.col("event_id")))
    return rules.text_verdict(e.select("pair_id").distinct(), f)


@query(f"""WITH {PAYLOAD_SQL}, e AS (SELECT bundle_id, CASE flag WHEN 'R' THEN 'missing' WHEN 'A' THEN 'unlisted' ELSE 'digest' END AS error FROM l WHERE flag IN ('R', 'A') OR size_bytes % 10 = 0)
SELECT bundle_id, count(error) = 0 AS valid, coalesce(string_agg(DISTINCT error, ',' ORDER BY error), '') AS errors FROM (SELECT DISTINCT bundle_id FROM l) LEFT JOIN e USING (bundle_id) GROUP BY 1""")
def agg_bundle_status(spark, sf_dir):
    """AGG-25: the bundles of the derived payloads, with their distinct errors."""
    listed, actual = _payloads(spark, sf_dir)
    every = listed.select("bundle_id").union(actual.select("bundle_id")).distinct()
    return events.bundle_status(every, events.reconcile_payloads(listed, actual)).select("bundle_id", "valid", F.array_join("errors", ",").alias("errors"))


@query("""WITH l AS (SELECT l_orderkey AS pair_id, l_linenumber::INTEGER AS rect_id, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity)::BIGINT AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
c AS (SELECT pair_id, rect_id, p % 10 AS x0, s % 10 AS y0, p % 10 + CASE WHEN rect_id = 7 THEN 0 ELSE 1 + p % 4 END AS x1, s % 10 + 1 + q % 3 AS y1 FROM l),
e AS (SELECT pair_id, (p + 3) % 8 - 1 AS x0, q % 8 - 1 AS y0, (p + 3) % 8 + 6 AS x1, q % 8 + 6 AS y1 FROM l), h AS (SELECT pair_id, p % 12 AS x0, s % 12 AS y0, p % 12 + 2 AS x1, s % 12 + 2 AS y1 FROM l WHERE f = 'R' AND p % 4 = 0),
cell AS (SELECT pair_id, rect_id, x, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM c)),
open AS (SELECT DISTINCT pair_id, rect_id FROM cell WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.pair_id = cell.pair_id AND e.x0 <= x AND x + 1 <= e.x1 AND e.y0 <= y AND y + 1 <= e.y1))
SELECT pair_id, rect_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.pair_id = c.pair_id AND h.x0 < c.x1 AND h.x1 > c.x0 AND h.y0 < c.y1 AND h.y1 > c.y0) THEN 'fail' WHEN c.x0 < c.x1 AND o.rect_id IS NULL THEN 'pass' ELSE 'review' END AS outcome
FROM c LEFT JOIN open o USING (pair_id, rect_id)""")
def rul_region_outcome(spark, sf_dir):
    """RUL-16, WIN-15: changed regions of each order against protected boxes and the union of the expected ones, told cell by cell in SQL."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("rect_id")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("f"))  # noqa: E741
    l = kept(l)  # noqa: E741
    box = lambda x0, y0, x1, y1: [c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)]
    p, s, q = F.col("p"), F.col("s"), F.col("q")
    changed = l.select("pair_id", "rect_id", *box(p % 10, s % 10, p % 10 + F.when(F.col("rect_id") == 7, 0).otherwise(1 + p % 4), s % 10 + 1 + q % 3))
    expected = l.select("pair_id", *box((p + 3) % 8, q % 8, (p + 3) % 8 + 5, q % 8 + 5))
    protected = l.where("f = 'R' AND p % 4 = 0").select("pair_id", *box(p % 12, s % 12, p % 12 + 2, s % 12 + 2))
    return grid.region_outcome(changed, expected, protected, 1.0).select("pair_id", "rect_id", "outcome")


_RULES = ("integrity.z", "selector.a", "expected.b", "protected.c", "feature.d", "visual.e", "clause.f")


@query(f"""WITH f AS (SELECT l_suppkey % 20 AS pair_id, {list(_RULES)}[l_linenumber] AS rule_id, l_orderkey || ':' || l_linenumber AS location, l_linenumber - 1 AS phase FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_orderkey FROM lineitem)),
o AS (SELECT DISTINCT * FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY phase, rule_id, location) AS n, count(*) OVER (PARTITION BY pair_id) AS total FROM o),
c AS (SELECT pair_id, rule_id, location, phase FROM n WHERE total <= 1000 OR n < 1000 UNION ALL SELECT DISTINCT pair_id, 'integrity.too-many-findings', '', 0 FROM n WHERE total > 1000)
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY phase, rule_id, location)::INTEGER AS n, rule_id, location FROM c""")
def ord_findings_capped(spark, sf_dir):
    """ORD-01, ORD-02: findings in order, of each pair at most 1,000 with the one that says so."""
    line = F.col("l_linenumber").cast("int")
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("pair_id"), line.alias("line"), "l_orderkey").distinct()  # noqa: E741
    f = l.select(*rules.finding(F.element_at(F.array(*map(F.lit, _RULES)), F.col("line")), "fail", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("line").cast("string")))).distinct()
    return rules.order_findings(rules.cap_findings(f)).select("pair_id", "n", "rule_id", "location")


@query(f"""WITH {LOG_SQL}, t AS (SELECT count(*) AS total FROM log) SELECT bundle_id, sequence, event_id, total, CASE WHEN total > 300 THEN 300::BIGINT END AS next_cursor FROM (SELECT * FROM log ORDER BY bundle_id, sequence LIMIT 100 OFFSET 200), t""")
def ord_event_page(spark, sf_dir):
    """ORD-03: a page of 100 of all events (of a wish for 500) from the two hundredth on."""
    log = events.decision_log(table(spark, sf_dir, "events")).select("bundle_id", "sequence", "event_id")
    return events.page(log, ["bundle_id", "sequence"], 200, 500)


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS pair_id, 'p' || (l_partkey % 90) AS place FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY place) AS n FROM d)
SELECT pair_id, string_agg(place, ',' ORDER BY place) AS locations FROM n WHERE n <= 32 GROUP BY 1""")
def ord_stable_locations(spark, sf_dir):
    """ORD-05: the first 32 distinct places of each supplier's parts."""
    places = F.collect_list(F.concat(F.lit("p"), (F.col("l_partkey") % 90).cast("string")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pair_id")).agg(F.array_join(rules.stable_locations(places), ",").alias("locations"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '.pdf' WHEN 1 THEN event_type || '.docx' ELSE event_type END AS name,
'could not read "' || CASE event_id % 4 WHEN 2 THEN event_type WHEN 3 THEN '/data/revverify/' || event_type || '/' ELSE '<temporary>' END || '": gone' AS warning FROM events""")
def fn_basename_scrub(spark, sf_dir):
    """FN-23: names of files, and warnings without temporary places."""
    e, k, t = table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    path = F.when(k % 4 == 0, say("/tmp/revverify-verify-", k, "/", t, ".pdf")).when(k % 4 == 1, say("C:\\Users\\a b\\revverify-visual-x\\", t, ".docx")).when(k % 4 == 2, t).otherwise(say("/data/revverify/", t, "/"))
    return e.select("event_id", fn.basename(path).alias("name"), fn.scrub(say('could not read "', path, '": gone')).alias("warning"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS pair_id, l_linenumber::INTEGER AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_linenumber)::INTEGER AS a FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2)),
s AS (SELECT pair_id, list(a ORDER BY b) AS xs FROM l GROUP BY 1),
r AS (SELECT pair_id, xs, 0 AS i, []::BIGINT[] AS best FROM s
  UNION ALL SELECT pair_id, xs, i + 1, list_append(best, 1 + coalesce(list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN xs[j] < xs[i + 1] THEN best[j] ELSE 0 END)), 0)) FROM r WHERE i < len(xs))
SELECT pair_id, list_max(best) AS anchors, true AS rising FROM r WHERE i = len(xs)""")
def udf_in_order_anchors(spark, sf_dir):
    """UDF-02: of each order's lines against their parts' order, how many can be kept in order, and that those kept are."""
    from pyspark.sql import window as W

    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("b")).agg(F.max("l_partkey").alias("p"))  # noqa: E741
    m = l.select("pair_id", "b", F.row_number().over(W.Window.partitionBy("pair_id").orderBy("p", "b")).alias("a"))
    got = diff.in_order_anchors(m).withColumn("up", F.coalesce(F.col("a") > F.lag("a").over(W.Window.partitionBy("pair_id").orderBy("b")), F.lit(True)))
    return got.groupBy("pair_id").agg(F.count("*").alias("anchors"), F.min("up").alias("rising"))
