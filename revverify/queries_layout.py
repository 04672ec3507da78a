"""Queries of page layout over word tables derived from line items, and of headings over contracts derived from orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import layout
from .operators.clauses import outline_of
from .plans.materialize import kept
from .registry import query
from .sources.corpus import spread, table

WIDTH = 600.0


def words(spark, sf_dir) -> DataFrame:
    """A word for each line item on its supplier's page: 40 rows a page, every fifth with a baseline that drifts. Pages have one column, two, or two with rows across, by turns."""
    k, c, o = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey") % 40
    page, wide = F.col("l_suppkey"), F.col("l_suppkey") % 3
    drift = F.when(o % 5 == 0, 0.75 * (c - 1)).otherwise((k % 3) * 0.5)
    top = (60 + 16 * o + drift).cast("double")
    one = 40 + 75 * (c - 1) + k % 20
    two = F.when(c % 2 == 1, 40 + 30 * (c - 1) + k % 10).otherwise(320 + 30 * (c - 2) + k % 10)
    x0 = F.when((wide == 2) & (o % 8 == 0) & (c == 1), 250).when(wide == 0, one).otherwise(two).cast("double")
    x1 = x0 + F.when((wide == 2) & (o % 8 == 0) & (c == 1), 100).otherwise(12 + k % 15)
    text = F.concat(F.col("l_returnflag"), k.cast("string"))
    return table(spark, sf_dir, "lineitem").select(page.alias("page_id"), text.alias("text"), x0.alias("x0"), top.alias("top"), x1.cast("double").alias("x1"), (top + 10).alias("bottom")).distinct()


def pages_of(w: DataFrame) -> DataFrame:
    return w.select("page_id").distinct().withColumn("width", F.lit(WIDTH))


WORDS_SQL = """word AS (
  SELECT DISTINCT l_suppkey AS page_id, l_returnflag || l_partkey AS text, x0::DOUBLE AS x0, top::DOUBLE AS top, (x0 + CASE WHEN wide THEN 100 ELSE 12 + l_partkey % 15 END)::DOUBLE AS x1, top::DOUBLE + 10 AS bottom FROM (
    SELECT *, l_suppkey % 3 = 2 AND l_orderkey % 40 % 8 = 0 AND l_linenumber = 1 AS wide,
      60 + 16 * (l_orderkey % 40) + CASE WHEN l_orderkey % 5 = 0 THEN 0.75 * (l_linenumber - 1) ELSE l_partkey % 3 * 0.5 END AS top,
      CASE WHEN l_suppkey % 3 = 2 AND l_orderkey % 40 % 8 = 0 AND l_linenumber = 1 THEN 250 WHEN l_suppkey % 3 = 0 THEN 40 + 75 * (l_linenumber - 1) + l_partkey % 20
        WHEN l_linenumber % 2 = 1 THEN 40 + 30 * (l_linenumber - 1) + l_partkey % 10 ELSE 320 + 30 * (l_linenumber - 2) + l_partkey % 10 END AS x0 FROM lineitem)),
tops AS (SELECT DISTINCT page_id, top FROM word),
jump AS (SELECT a.page_id, a.top, min(b.top) AS next FROM tops a LEFT JOIN tops b ON b.page_id = a.page_id AND b.top - a.top > 3 GROUP BY ALL),
firsts AS (
  SELECT page_id, min(top) AS line_top FROM tops GROUP BY 1
  UNION ALL SELECT j.page_id, j.next FROM firsts f JOIN jump j ON j.page_id = f.page_id AND j.top = f.line_top WHERE j.next IS NOT NULL),
placed AS (SELECT word.*, max(line_top) AS line_top FROM word JOIN firsts ON firsts.page_id = word.page_id AND firsts.line_top <= word.top GROUP BY ALL)"""
_LINE = "string_agg(text, ' ' ORDER BY x0, top, text) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom"


@query(f"WITH RECURSIVE {WORDS_SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line_top)::INTEGER AS line_no, text, x0, top, x1, bottom FROM (SELECT page_id, line_top, {_LINE} FROM placed GROUP BY 1, 2)")
def win_words_to_lines(spark, sf_dir):
    """WIN-10 over the derived words."""
    return layout.words_to_lines(words(spark, sf_dir))


@query(f"""WITH RECURSIVE {WORDS_SQL},
vote AS (SELECT page_id, line_top, coalesce(min(x0) FILTER (WHERE x0 >= 300) - max(x1) FILTER (WHERE x1 <= 300) >= 15, false) AS split, bool_or(x0 < 300 AND x1 > 300) AS over FROM placed GROUP BY 1, 2),
cols AS (SELECT page_id, CASE WHEN count(*) FILTER (WHERE split) >= 8 AND count(*) FILTER (WHERE split) / count(*) >= 0.6 THEN 2 ELSE 1 END AS columns FROM vote GROUP BY 1),
sect AS (SELECT page_id, line_top, columns, columns = 2 AND over AS across, coalesce(sum((columns = 2 AND over)::INTEGER) OVER (PARTITION BY page_id ORDER BY line_top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM vote JOIN cols USING (page_id)),
sided AS (SELECT placed.*, columns, section, CASE WHEN across THEN 2 WHEN columns = 1 OR x1 <= 300 THEN 0 ELSE 1 END AS side FROM placed JOIN sect USING (page_id, line_top)),
line AS (SELECT page_id, columns, section, side, line_top, {_LINE} FROM sided GROUP BY 1, 2, 3, 4, 5)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY section, side, line_top)::INTEGER AS line_no, columns::INTEGER AS columns, text, x0, top, x1, bottom FROM line""")
def win_reading_order(spark, sf_dir):
    """WIN-11 over the derived words: pages of one column, of two, and of two with rows across."""
    w = kept(words(spark, sf_dir))
    return layout.reading_order(w, pages_of(w))


# A document of each order, told once as data: (which remainders of the order's number by 6 have the block, type, text or None for a text by the order, left edge, right edge, page, fill line).
_ALL = (0, 1, 2, 3, 4, 5)
_BLOCKS = (
    ((0, 1, 2, 4), "paragraph", "设备采购合同", 200, 400, 0, False),
    ((0, 1, 2, 4), "paragraph", "使用说明", 200, 400, 0, False),
    ((0, 2, 4), "paragraph", "一、本说明供双方阅读", 60, 300, 0, False),
    ((1,), "paragraph", "第一条 说明范围", 60, 300, 0, False),
    ((0, 1, 4), "paragraph", "设备采购合同", 200, 400, 0, False),
    (_ALL, "header", "第九条 页眉", 60, 200, 1, False),
    (_ALL, "paragraph", "附件一", 60, 120, 1, False),
    ((0, 2, 3), "paragraph", "总 则 说 明", 60, 200, 1, False),
    (_ALL, "paragraph", "第一条 定义", 60, 180, 1, False),
    (_ALL, "paragraph", "本合同所称货物见清单。", 60, 500, 1, False),
    ((0, 3, 5), "paragraph", "第二章 价款", 60, 200, 1, False),
    ((2, 4), "paragraph", "第二章 价款；另见附表", 60, 300, 1, False),
    (_ALL, "paragraph", "一、 ：支付方式", 60, 220, 1, False),
    (_ALL, "paragraph", "（一）首付款", 90, 220, 1, False),
    (_ALL, "paragraph", "第二条 交货期限由双方按照订单逐项约定并且以书面确认为准否则视为没有约定任何期限", 60, 560, 1, False),
    (_ALL, "paragraph", "（二）补充", 90, 220, 1, False),
    (_ALL, "paragraph", "1.1 交货地点", 310, 520, 1, False),
    (_ALL, "paragraph", "1.2 交货时间", 310, 420, 1, False),
    (_ALL, "paragraph", "第三条 验收____", 60, 220, 1, True),
    (_ALL, "heading", None, 60, 590, 2, False),
    (_ALL, "paragraph", "第一条 定义", 60, 180, 2, False),
    (_ALL, "paragraph", "第四条 争议", 60, 180, 9, False),
    ((0, 1, 2, 3), "paragraph", "附录A", 60, 120, 2, False),
    (_ALL, "paragraph", "第五条 其他", 60, 180, 2, False),
)
_PAGED = (0, 1, 2, 3)


def documents_of_orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Blocks and pages of a document for each order, paged for remainders 0 to 3."""
    o = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 6).alias("kind")), "doc_id")
    paged = F.col("kind").isin(*_PAGED)
    rows = [
        F.when(F.col("kind").isin(*kinds), F.struct(F.lit(i).alias("ordinal"), F.lit(type_).alias("content_type"), F.lit(text).alias("text") if text else F.concat(F.lit("特别约定 "), F.col("doc_id").cast("string")).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(page).alias("page_index"), F.lit(fill).alias("fill")))
        for i, (kinds, type_, text, x0, x1, page, fill) in enumerate(_BLOCKS)
    ]
    b = o.select("doc_id", paged.alias("paged"), F.explode(F.array_compact(F.array(*rows))).alias("b")).select("doc_id", "paged", "b.*")
    only = lambda c: F.when(F.col("paged"), F.col(c)).alias(c)
    blocks = b.select("doc_id", "ordinal", "content_type", "text", F.when(F.col("paged"), "pdf").otherwise("docx").alias("format"), only("page_index"), only("x0"), only("x1"), "fill")
    pages = o.where(paged).select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("page_index"), F.lit(WIDTH).alias("width"))
    return blocks, pages


_ROWS_SQL = ", ".join(f"({i}, {list(kinds)}, '{t}', {'NULL' if x is None else repr(x)}, {x0}::DOUBLE, {x1}::DOUBLE, {p}, {f})" for i, (kinds, t, x, x0, x1, p, f) in enumerate(_BLOCKS))
BLOCKS_SQL = f"""told(ordinal, kinds, content_type, said, x0, x1, page, fill) AS (VALUES {_ROWS_SQL}),
blk AS (
  SELECT o_orderkey AS doc_id, ordinal, content_type, coalesce(said, '特别约定 ' || o_orderkey) AS text, o_orderkey % 6 < 4 AS paged, CASE WHEN o_orderkey % 6 < 4 THEN page END AS page, CASE WHEN o_orderkey % 6 < 4 THEN x0 END AS x0,
    CASE WHEN o_orderkey % 6 < 4 THEN x1 END AS x1, fill FROM orders JOIN told ON list_contains(kinds, (o_orderkey % 6)::INTEGER)),
clean AS (SELECT *, CASE WHEN text = '总 则 说 明' THEN '总则说明' ELSE text END AS clean, text = '总 则 说 明' AS spaced FROM blk)"""
# Titles that fit, told by what PRJ-14 asks of them.
_LIKE = """CASE WHEN fill THEN false WHEN content_type = 'heading' THEN {0} <> '' WHEN {0} = '' OR regexp_matches({0}, '[。！？；;：:]') THEN false WHEN NOT paged THEN length({0}) <= 32 WHEN page > 2 THEN false
  WHEN x0 < 300 THEN x1 <= 444 ELSE x1 - x0 <= (600 - x0) * 0.74 END"""


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, ordinal, {_LIKE.format('text')} AS title_like FROM blk")
def prj_title_like(spark, sf_dir):
    """PRJ-14 over the derived documents' blocks."""
    blocks, pages = documents_of_orders(spark, sf_dir)
    # The widths of a document's pages go to it as one map, so blocks and pages stay where orders were dealt and no text is exchanged.
    widths = pages.groupBy("doc_id", "page_index").agg(F.max("width").alias("width")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_index", "width"))).alias("widths"))
    b = blocks.join(widths, "doc_id", "left").withColumn("width", F.try_element_at("widths", F.col("page_index")))
    return b.select("doc_id", "ordinal", layout.title_like(F.col("text")).alias("title_like"))


PARTS_SQL = """part AS (SELECT *, CASE WHEN regexp_matches(clean, '^第[一二三四五六七八九十]+章') THEN 'chapter' WHEN regexp_matches(clean, '^[一二三四五六七八九十]+、') THEN 'list' END AS part_kind,
  CASE WHEN regexp_matches(clean, '^第[一二三四五六七八九十]+章') THEN split_part(clean, '章', 1) || '章' WHEN regexp_matches(clean, '^[一二三四五六七八九十]+、') THEN split_part(clean, '、', 1) || '、' END AS part_label FROM clean),
parts AS (SELECT *, CASE WHEN part_kind IS NOT NULL THEN ltrim(substr(clean, length(part_label) + 1), ' ：:　') END AS part_title FROM part)"""


@query(f"WITH {BLOCKS_SQL}, {PARTS_SQL} SELECT doc_id, ordinal, spaced, clean, part_kind, part_label, part_title FROM parts")
def prj_heading_parts(spark, sf_dir):
    """PRJ-15 over the derived documents' blocks."""
    return layout.heading_parts(documents_of_orders(spark, sf_dir)[0]).select("doc_id", "ordinal", "spaced", "clean", "part_kind", "part_label", "part_title")


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, {PARTS_SQL},
marked AS (SELECT *, CASE WHEN content_type = 'header' THEN NULL WHEN regexp_matches(clean, '^第[一二三四五六七八九十]+条') THEN 1 WHEN regexp_matches(clean, '^[0-9]+[.][0-9]') THEN 2 WHEN part_kind = 'list' THEN 2 WHEN starts_with(clean, '（') THEN 3 WHEN content_type = 'heading' THEN 1 END AS level FROM parts),
named AS (SELECT *, CASE WHEN level = 1 AND content_type <> 'heading' THEN split_part(clean, '条', 1) || '条' WHEN part_kind = 'list' THEN part_label WHEN level = 2 THEN split_part(clean, ' ', 1) WHEN level = 3 THEN split_part(clean, '）', 1) || '）' ELSE '' END AS label FROM marked),
own AS (SELECT *, CASE WHEN level IS NOT NULL THEN ltrim(substr(clean, length(label) + 1), ' ：:　') END AS own FROM named),
up AS (SELECT a.*, (SELECT max(b.ordinal) FROM own b WHERE b.doc_id = a.doc_id AND b.ordinal < a.ordinal AND b.level < a.level
  AND NOT EXISTS (SELECT 1 FROM own c WHERE c.doc_id = a.doc_id AND c.ordinal > b.ordinal AND c.ordinal < a.ordinal AND c.level <= b.level)) AS parent FROM (SELECT * FROM own) a),
notes AS (SELECT doc_id, min(ordinal) AS note FROM blk WHERE paged AND text IN ('使用说明', '填写说明') GROUP BY 1),
ends AS (SELECT b.doc_id, min(b.ordinal) FILTER (WHERE b.level IS NOT NULL AND b.part_kind IS DISTINCT FROM 'list' AND b.level <> 3 AND b.content_type <> 'heading') AS clause, min(b.ordinal) FILTER (WHERE b.text = '设备采购合同') AS again FROM own b JOIN notes USING (doc_id) WHERE b.ordinal > note GROUP BY 1),
body AS (SELECT doc_id, again AS body FROM ends WHERE again < coalesce(clause, 999)),
seen AS (SELECT up.* FROM up LEFT JOIN body USING (doc_id) WHERE ordinal >= coalesce(body, 0) AND content_type <> 'header'),
liked AS (SELECT *, part_kind IS NOT NULL AND {_LIKE.format('part_title')} AS part_ok, level IS NOT NULL AND {_LIKE.format('own')} AND (content_type = 'heading' OR label <> '') AS own_ok FROM seen),
good AS (
  SELECT doc_id, ordinal FROM liked WHERE level IS NOT NULL AND ((part_ok AND part_kind = 'list') OR (NOT part_ok AND own_ok AND (parent IS NULL OR content_type = 'heading')))
  UNION ALL SELECT l.doc_id, l.ordinal FROM good g JOIN liked l ON l.doc_id = g.doc_id AND l.parent = g.ordinal WHERE NOT l.part_ok AND l.own_ok AND l.content_type <> 'heading'),
told2 AS (SELECT l.doc_id, l.ordinal, l.clean, CASE WHEN part_ok THEN part_label || ' ' || part_title WHEN l.level IS NOT NULL AND g.ordinal IS NOT NULL THEN trim(label || ' ' || own)
  WHEN l.level IS NULL AND spaced AND {_LIKE.format('clean')} THEN clean END AS heading FROM liked l LEFT JOIN (SELECT DISTINCT * FROM good) g ON g.doc_id = l.doc_id AND g.ordinal = l.ordinal),
begun AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS begun FROM told2),
cut AS (SELECT doc_id, min(ordinal) AS stop FROM begun WHERE begun AND clean IN ('附件一', '附录A') GROUP BY 1),
once AS (SELECT doc_id, heading, min(ordinal)::INTEGER AS ordinal FROM begun LEFT JOIN cut USING (doc_id) WHERE heading IS NOT NULL AND ordinal < coalesce(stop, 999) GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal)::INTEGER AS heading_no, ordinal, heading FROM once""")
def win_display_headings(spark, sf_dir):
    """WIN-13 over the derived documents: usage notes with and without the cover title again, chapters, lists, spaced signs, parents that do not count, annexes before and after the first heading."""
    blocks, pages = documents_of_orders(spark, sf_dir)
    b = kept(blocks)
    return layout.display_headings(b, kept(outline_of(b)), pages)
