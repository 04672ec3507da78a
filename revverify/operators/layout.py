"""Page layout: words to lines, reading order of two columns, title-like blocks, display headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans.materialize import kept
from .clauses import parse_marker

# The greatest distance of a word's top from its line's first one; when a page has two columns; how far a title may reach; how long it may be.
LINE_STEP = 3.0
COLUMN_ROWS, COLUMN_SHARE, GUTTER = 8, 0.6, 0.025
TITLE_REACH, TITLE_CHARS = 0.74, 32
# Numerals, sentence signs, and the words of notes, annexes and contract titles.
HAN, NUMERALS, SENTENCE = "\\x{4e00}-\\x{9fff}", "一二三四五六七八九十百千", "。！？；;：:"
NOTES, ANNEXES, KINDS_OF_CONTRACT = ("使用说明", "填写说明"), ("附件", "附录"), ("合同书", "合同", "协议书", "协议")


def line_anchors(words: DataFrame) -> DataFrame:
    """WIN-10, the fold: (page_id, top, line_top) for each distinct top of words (page_id, top).

    A line ends at the first top more than ``LINE_STEP`` below its *first* one, so a slowly drifting baseline is cut where the drift has
    added up. A step of more than that always starts a line, so tops are folded in runs between such steps: only the distinct tops of one run meet in an array.
    """
    tops = words.select("page_id", "top").distinct()
    page = W.Window.partitionBy("page_id").orderBy("top")
    gap = (F.col("top") - F.lag("top").over(page) > LINE_STEP).cast("int")
    runs = tops.withColumn("run", F.sum(F.coalesce(gap, F.lit(0))).over(page)).groupBy("page_id", "run").agg(F.array_sort(F.collect_list("top")).alias("tops"))
    empty = F.array().cast("array<struct<top:double,line_top:double>>")

    def step(s: Column, top: Column) -> Column:
        first = F.when(s["first"].isNull() | (top - s["first"] > LINE_STEP), top).otherwise(s["first"])
        return F.struct(first.alias("first"), F.concat(s["out"], F.array(F.struct(top.alias("top"), first.alias("line_top")))).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("first"), empty.alias("out"))
    return runs.select("page_id", F.inline(F.aggregate("tops", start, step, lambda s: s["out"])))


def _lines(words: DataFrame, *by: str) -> DataFrame:
    """Words of each line in order of x0, top and text, as one text with the union of their boxes."""
    inner = F.array_sort(F.collect_list(F.struct("x0", "top", "text")))
    box = [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]
    return words.groupBy(*by).agg(F.array_join(F.transform(inner, lambda w: w["text"]), " ").alias("text"), *box)


def in_lines(words: DataFrame) -> DataFrame:
    """Words (page_id, text, x0, top, x1, bottom) with the line_top of their line."""
    return words.join(line_anchors(words), ["page_id", "top"])


def words_to_lines(words: DataFrame) -> DataFrame:
    """WIN-10: lines (page_id, line_no, text, x0, top, x1, bottom) of words; line_no from 1."""
    lines = _lines(in_lines(words), "page_id", "line_top")
    return lines.select("page_id", F.row_number().over(W.Window.partitionBy("page_id").orderBy("line_top")).alias("line_no"), "text", "x0", "top", "x1", "bottom")


def two_columns(words: DataFrame, pages: DataFrame) -> DataFrame:
    """The gutter vote: (page_id, rows, separated, columns: 1 or 2) of words with line_top and pages (page_id, width).

    A row votes for two columns when it has words on both sides of the middle and at least the gutter between them.
    """
    w = words.join(pages.select("page_id", "width"), "page_id")
    middle = F.col("width") / 2
    left, right = F.max(F.when(F.col("x1") <= middle, F.col("x1"))), F.min(F.when(F.col("x0") >= middle, F.col("x0")))
    rows = w.groupBy("page_id", "line_top").agg(F.coalesce(right - left >= F.first("width") * GUTTER, F.lit(False)).alias("vote"))
    votes = rows.groupBy("page_id").agg(F.count("*").alias("rows"), F.count_if("vote").alias("separated"))
    both = (F.col("separated") >= COLUMN_ROWS) & (F.col("separated") / F.col("rows") >= COLUMN_SHARE)
    return votes.withColumn("columns", F.when(both, 2).otherwise(1))


def reading_order(words: DataFrame, pages: DataFrame) -> DataFrame:
    """WIN-11: lines (page_id, line_no, columns, text, x0, top, x1, bottom) in reading order.

    On a page of two columns, rows with a word across the middle close a section: before each of them come all left lines of its section, then all right ones.
    Other pages are read row by row.
    """
    w = in_lines(words)
    w = w.join(two_columns(w, pages).select("page_id", "columns"), "page_id").join(pages.select("page_id", "width"), "page_id")
    middle = F.col("width") / 2
    across = F.col("columns").eqNullSafe(2) & (F.col("x0") < middle) & (F.col("x1") > middle)
    row = w.groupBy("page_id", "line_top").agg(F.max(across).alias("across"))
    before = W.Window.partitionBy("page_id").orderBy("line_top").rowsBetween(W.Window.unboundedPreceding, -1)
    row = row.withColumn("section", F.coalesce(F.sum(F.col("across").cast("int")).over(before), F.lit(0)))
    w = w.join(row, ["page_id", "line_top"])
    # A word may stand on both sides when it has no width and lies on the middle. Whole rows of other pages count as left.
    sides = F.when(F.col("across"), F.array(F.lit(2))).when(F.col("columns") == 1, F.array(F.lit(0)))
    sides = sides.otherwise(F.array_compact(F.array(F.when(F.col("x1") <= middle, 0), F.when(F.col("x0") >= middle, 1))))
    lines = _lines(w.withColumn("side", F.explode(sides)), "page_id", "columns", "section", "side", "line_top")
    order = W.Window.partitionBy("page_id").orderBy("section", "side", "line_top")
    return lines.select("page_id", F.row_number().over(order).alias("line_no"), "columns", "text", "x0", "top", "x1", "bottom")


def _after_label(text: Column) -> Column:
    return F.regexp_replace(text, "^[ \\x{3000}:：]+", "")


def title_like(text: Column) -> Column:
    """PRJ-14: may the text stand as the title of its block (fill, content_type, format, page_index, x0, x1, and of its page width; null where there is none)."""
    signs = F.exists(F.split(F.lit(SENTENCE), ""), lambda c: (c != "") & F.contains(text, c))
    left = F.col("x0") < F.col("width") / 2
    reach = F.when(left, F.col("x1") <= F.col("width") * TITLE_REACH).otherwise(F.col("x1") - F.col("x0") <= (F.col("width") - F.col("x0")) * TITLE_REACH)
    placed = (F.col("format") == "pdf") & F.col("x0").isNotNull() & F.col("page_index").isNotNull()
    return (
        F.when(F.coalesce("fill", F.lit(False)), False).when(F.col("content_type") == "heading", text != "").when((text == "") | signs, False)
        .when(~F.coalesce(placed, F.lit(False)), F.length(text) <= TITLE_CHARS).otherwise(F.coalesce(reach, F.lit(False)))
    )


def heading_parts(blocks: DataFrame) -> DataFrame:
    """PRJ-15: blocks (.., text) with ``clean``: without outer space and, where three Han signs in a row are spaced out, without gaps between Han signs; ``spaced`` tells so.

    ``part_kind`` is chapter or list where the text begins with such a label, which is then ``part_label``, and ``part_title`` what follows it.
    """
    strip = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    spaced = strip.rlike(rf"(?U)([{HAN}]\s+){{3}}")
    signs = rf"[{HAN}、，。]"
    b = blocks.withColumn("spaced", spaced).withColumn("clean", F.when(spaced, F.regexp_replace(strip, rf"(?U)(?<={signs})\s+(?={signs})", "")).otherwise(strip))
    chapter, item = rf"(?U)^(第\s*[{NUMERALS}零〇两0-9]+\s*章)\s*(\S.*)$", rf"(?U)^([{NUMERALS}]+、)\s*(\S.*)$"
    kind = F.when(F.col("clean").rlike(chapter), "chapter").when(F.col("clean").rlike(item), "list")
    pick = lambda i: F.when(F.col("part_kind") == "chapter", F.regexp_extract("clean", chapter, i)).when(F.col("part_kind") == "list", F.regexp_extract("clean", item, i))
    return b.withColumn("part_kind", kind).withColumn("part_label", pick(1)).withColumn("part_title", _after_label(pick(2)))


def body_start(blocks: DataFrame) -> DataFrame:
    """(doc_id, body): first ordinal of the body of paged documents whose usage notes are followed by their cover title once more; others have no row.

    Blocks come with ``clean`` and the marker's ``scheme``. A clause of any kind but a Chinese list ends the search: then the notes are no front matter.
    """
    b = blocks.where("format = 'pdf'").select("doc_id", "ordinal", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("line"), "scheme")
    notes = b.where(F.col("line").isin(*NOTES)).groupBy("doc_id").agg(F.min("ordinal").alias("note"))
    b = b.join(notes, "doc_id")
    title = F.col("line").rlike(rf"^.{{1,30}}(?:{'|'.join(KINDS_OF_CONTRACT)})$")
    covers = b.where((F.col("ordinal") < F.col("note")) & title).select("doc_id", "line").distinct().withColumn("again", F.lit(True))
    after = b.where("ordinal > note").join(covers, ["doc_id", "line"], "left")
    clause = F.coalesce(F.col("scheme") != "chinese_list", F.lit(False))
    first = after.where(clause | F.col("again")).groupBy("doc_id").agg(F.min_by(F.when(~clause, F.col("ordinal")), "ordinal").alias("body"))
    return first.where("body IS NOT NULL")


def display_headings(blocks: DataFrame, clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """WIN-13: headings (doc_id, heading_no from 1, ordinal, heading) that stand apart from the body, in order, each text once.

    Blocks (doc_id, ordinal, content_type, text, format, page_index, x0, x1, fill); clauses (doc_id, clause_no, label, heading, parent_no); pages (doc_id, page_index, width).
    A clause's heading counts if it is title-like and its parent's counted, or if it is a heading by type; chapters and Chinese list items count by their own text. Reading begins at the body and ends
    at an annex that follows a heading.
    """
    # What clauses and pages say goes to a document's blocks as maps, so blocks are dealt by document once and their texts are not exchanged for each join.
    order = W.Window.partitionBy("doc_id").orderBy("ordinal")
    counted = F.coalesce(~F.col("content_type").isin("header", "footer"), F.lit(False))
    b = blocks.withColumn("marker", parse_marker(F.col("text"))).withColumn("starts", F.coalesce(counted & ((F.col("content_type") == "heading") | F.col("marker").isNotNull()), F.lit(False)))
    number = F.sum(F.col("starts").cast("int")).over(order.rowsBetween(W.Window.unboundedPreceding, 0)).cast("int")
    b = b.withColumn("clause_no", F.when(F.col("starts"), number)).withColumn("scheme", F.when(F.col("starts"), F.col("marker.scheme"))).drop("marker", "starts")
    own = clauses.where("heading <> ''").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("clause_no", F.struct("label", F.col("heading").alias("own"), "parent_no")))).alias("owns"))
    widths = pages.groupBy("doc_id", "page_index").agg(F.max("width").alias("width")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_index", "width"))).alias("widths"))
    b = b.join(own, "doc_id", "left").join(widths, "doc_id", "left").withColumn("told_", F.try_element_at("owns", F.col("clause_no"))).withColumn("width", F.try_element_at("widths", F.col("page_index")))
    b = heading_parts(b.withColumns({c: F.col(f"told_.{c}") for c in ("label", "own", "parent_no")}).drop("owns", "widths", "told_"))
    ahead = F.coalesce((F.lead("page_index").over(order).eqNullSafe(F.col("page_index"))) & (F.lead("own").over(order).isNotNull()) & (F.lead("label").over(order) != ""), F.lit(False))
    b = b.withColumn("ahead", ahead).join(body_start(b), "doc_id", "left")
    b = b.where((F.col("ordinal") >= F.coalesce("body", F.lit(0))) & ~F.col("content_type").isin("header", "footer"))
    part = F.col("part_kind").isNotNull() & title_like(F.col("part_title"))
    listed, apart = part & (F.col("part_kind") == "list"), ~part & F.col("own").isNull()
    titled, typed = title_like(_after_label(F.col("own"))), F.col("content_type") == "heading"
    labelled = F.col("own").isNotNull() & ~part & titled & (typed | (F.col("label") != ""))
    both = F.array_join(F.filter(F.array(F.col("label"), _after_label(F.col("own"))), lambda x: x != ""), " ")
    told = F.when(part, F.concat_ws(" ", "part_label", "part_title")).when(labelled, both).when(apart & F.col("spaced") & F.col("ahead") & title_like(F.col("clean")), F.col("clean"))
    root = F.col("parent_no").isNull() | typed
    annex = F.col("clean").rlike(rf"(?U)^(?:{'|'.join(ANNEXES)})\s*[A-Za-z0-9{NUMERALS}]*$")
    b = b.select("doc_id", "ordinal", "clause_no", "parent_no", annex.alias("annex"), told.alias("heading"), (labelled & ~root).alias("waits"), (F.col("own").isNotNull() & (listed | (labelled & root))).alias("sure"))
    b = kept(b)
    # A clause that waits for its parent counts when the chain above it ends in one that is sure; chains are as deep as the levels of the tree.
    sure = b.where("sure").select("doc_id", "clause_no")
    waiting = b.where("waits").select("doc_id", "clause_no", "parent_no")
    depth = clauses.agg(F.max("level")).first()[0] or 0 if "level" in clauses.columns else 8
    for _ in range(max(0, depth - 1)):
        more = waiting.join(sure.withColumnRenamed("clause_no", "parent_no"), ["doc_id", "parent_no"], "left_semi").select("doc_id", "clause_no")
        sure = sure.union(more).distinct()
    good = b.join(sure.withColumn("counts", F.lit(True)), ["doc_id", "clause_no"], "left")
    good = good.withColumn("heading", F.when(~F.col("waits") | F.col("counts"), F.col("heading")))
    far = order.rowsBetween(W.Window.unboundedPreceding, -1)
    good = good.withColumn("begun", F.coalesce(F.max(F.col("heading").isNotNull()).over(far), F.lit(False)))
    over = F.coalesce(F.max(F.col("annex") & F.col("begun")).over(order.rowsBetween(W.Window.unboundedPreceding, 0)), F.lit(False))
    good = good.withColumn("over", over).where("NOT over AND heading IS NOT NULL")
    once = good.groupBy("doc_id", "heading").agg(F.min("ordinal").alias("ordinal"))
    return once.select("doc_id", F.row_number().over(order).alias("heading_no"), "ordinal", "heading")
