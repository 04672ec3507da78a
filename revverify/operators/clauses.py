"""Clause structure: markers, segmentation, tree, ids, language, protected regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import ASCII, fp, let, norm, norm_of_others, normalized, normalized_with, stable_id

# Numerals that labels count by, and labels in order of precedence: scheme, what stands before the numeral, its class, what stands after it, what may end the label, level (None: points of the number + 1).
_ZH = "一二三四五六七八九十百千"
NUMERAL_CLASSES = {"zh": f"[{_ZH}]+", "zh or digits": f"[{_ZH}零〇两0-9]+", "roman or digits": "[IVXLCDM0-9]+", "points": r"\d+(?:\.\d+)*", "some points": r"\d+(?:\.\d+)+"}
LABELS = (
    ("chinese_article", r"第\s*", "zh or digits", r"\s*条", "", 1), ("section", r"第\s*", "points", r"\s*节", "", None), ("article", r"Article\s+", "roman or digits", "", r"\b[.：:]?", 1), ("section", r"Section\s+", "points", "", r"\b[.：:]?", None),
    ("decimal", "", "some points", "", "[.、：:]?", None), ("chinese_list", "", "zh", "、", "", 2), ("chinese_list", "（", "zh", "）", "", 3),
)
#: Scheme, pattern (printed label first, heading last), level; English words in either case.
MARKERS = tuple((scheme, rf"{'(?i)' if before.isascii() and before else ''}^({before}{NUMERAL_CLASSES[numeral]}{after}){end}\s*(.*)$", level) for scheme, before, numeral, after, end, level in LABELS)
# First words of protected regions.
REGION_TERMS = (("signature", ("signature", "signed by", "签字", "签署", "签名")), ("seal", ("seal", "盖章", "公章", "印章")), ("attachment", ("attachment", "appendix", "annex", "schedule", "exhibit", "附件", "附录")))


def parse_marker(text: Column) -> Column:
    """PRJ-04: struct (scheme, printed, level, heading) of a text's first line; null without a marker."""

    def of(line: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for scheme, pattern, level in MARKERS:
            printed = F.regexp_extract(line, pattern, 1)
            depth = F.lit(level) if level else F.regexp_count(printed, F.lit("[.]")) + 1
            got = F.struct(F.lit(scheme).alias("scheme"), printed.alias("printed"), depth.cast("int").alias("level"), F.btrim(F.regexp_extract(line, pattern, 2)).alias("heading"))
            out = out.when(line.rlike(pattern), got)
        return out

    # Most lines hold none: one cheap look at the first signs spares them the patterns.
    line = F.regexp_extract(F.replace(text, F.lit("　"), F.lit(" ")), r"^([^\n\r\x0B\f\x{85}\x{2028}\x{2029}]*)", 1)
    return F.when(text.rlike(rf"^(?:第|[Aa][Rr][Tt]|[Ss][Ee][Cc]|\d|（|[{_ZH}])"), let(line, of))


def tag_regions(blocks: DataFrame) -> DataFrame:
    """PRJ-05: region_kind of blocks (content_type, text): header and footer by type, else by the first words."""
    n, kind = norm(F.col("text")), F.when(F.col("content_type").isin("header", "footer"), F.col("content_type"))
    for name, terms in REGION_TERMS:
        for t in terms:
            kind = kind.when(F.startswith(n, F.lit(t)), name)
    return blocks.withColumn("region_kind", kind)


def _keys(doc: str | tuple[str, ...]) -> tuple[str, ...]:
    """The columns that name a document: one, or several."""
    return (doc,) if isinstance(doc, str) else doc


def segment(blocks: DataFrame, doc: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """WIN-01: clause_no of each block (doc, ordinal, content_type, text): a heading or marker starts a clause; 0 is the preamble."""
    b = blocks.where("content_type NOT IN ('header', 'footer')").withColumn("marker", parse_marker(F.col("text")))
    starts = ((F.col("content_type") == "heading") | F.col("marker").isNotNull()).cast("int")
    order = W.Window.partitionBy(*_keys(doc)).orderBy("ordinal")
    return b.withColumn("starts", starts).withColumn("clause_no", F.sum("starts").over(order.rowsBetween(W.Window.unboundedPreceding, 0)).cast("int"))


def assemble_clauses(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """AGG-02: one row a clause: label, level, heading, text joined in order, norm and fingerprint."""
    return _joined(segments, doc).withColumn("norm", normalized(F.col("text"))).withColumn("fp", fp(F.col("norm")))


def _joined(segments: DataFrame, doc: str | tuple[str, ...]) -> DataFrame:
    """AGG-02 without norm and fingerprint."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "text", "marker", "starts")))
    c = segments.groupBy(*_keys(doc), "clause_no").agg(rows.alias("rows"))
    first = F.element_at("rows", 1)
    marker = F.when(first["starts"] == 1, first["marker"])
    heading = F.when(first["starts"] == 1, F.coalesce(F.when(marker["heading"] != "", marker["heading"]), F.btrim(F.substring_index(first["text"], "\n", 1)))).otherwise("")
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return c.select(*_keys(doc), "clause_no", F.coalesce(marker["printed"], F.lit("")).alias("label"), F.coalesce(marker["level"], F.when(first["starts"] == 1, 1).otherwise(0)).alias("level"), heading.alias("heading"), text.alias("text"))


def clause_tree(clauses: DataFrame, doc: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """WIN-02: parent_no and ancestor_path (headings) of each clause (doc, clause_no, level, heading), at any depth.

    A fold over a document's clauses in order keeps the open ancestors: those of smaller level than the clause. The preamble (level 0) is nobody's parent.
    """
    cols, keys = clauses.columns, _keys(doc)
    others = [c for c in cols if c not in keys]
    rows = clauses.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("clause_no", "level", "heading", F.struct(*others).alias("row")))).alias("rows"))
    up = "array<struct<clause_no:int,level:int,heading:string>>"
    none = F.array().cast(up)

    def step(s: Column, r: Column) -> Column:
        open_ = F.filter(s["open"], lambda x: x["level"] < r["level"])
        own = F.struct(r["clause_no"].cast("int").alias("clause_no"), r["level"].cast("int").alias("level"), r["heading"].alias("heading"))
        return F.struct(F.when(r["level"] > 0, F.concat(open_, F.array(own))).otherwise(s["open"]).alias("open"), F.concat(s["out"], F.array(F.when(r["level"] > 0, open_).otherwise(none))).alias("out"))

    ups = F.aggregate("rows", F.struct(none.alias("open"), F.array().cast(f"array<{up}>").alias("out")), step, lambda s: s["out"])
    flat = rows.select(*keys, F.inline(F.arrays_zip(F.transform("rows", lambda r: r["row"]).alias("row"), ups.alias("up"))))
    return flat.select(*[F.col(c) if c in keys else F.col(f"row.{c}") for c in cols], F.try_element_at("up", F.lit(-1))["clause_no"].alias("parent_no"), F.transform("up", lambda x: x["heading"]).alias("ancestor_path"))


def clause_ids(clauses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """WIN-03: clause_id from label, path, heading and the first 160 characters; ids that repeat take the fingerprint and a running number."""
    path = F.array_join("ancestor_path", "\0")
    base = stable_id("clause", F.col("label"), path, F.col("heading"), F.substring("norm", 1, 160))
    c = clauses.withColumn("base", base)
    many = F.count("*").over(W.Window.partitionBy(doc, "base")) > 1
    nth = F.row_number().over(W.Window.partitionBy(doc, "base", "fp").orderBy("clause_no")) - 1
    return c.withColumn("clause_id", F.when(many, stable_id("clause", F.col("base"), F.col("fp"), nth.cast("string"))).otherwise(F.col("base"))).drop("base")


def child_ids(clauses: DataFrame, doc: str = "doc_id") -> DataFrame:
    """AGG-03: the children of each parent, in order."""
    kids = clauses.where("parent_no IS NOT NULL").groupBy(doc, F.col("parent_no").alias("clause_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("clause_no").alias("n"), F.col("clause_id").alias("i")))).alias("kids"))
    return kids.select(doc, "clause_no", F.transform("kids", lambda k: k["i"]).alias("child_ids"))


def table_refs(blocks: DataFrame) -> DataFrame:
    """PRJ-06: references (doc_id, ordinal) to the blocks that are tables."""
    return blocks.where("content_type = 'table'").select("doc_id", "ordinal")


def visible_blocks(blocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """PRJ-01: block texts (doc_id, ordinal, text) replaced by their visible text (doc_id, ordinal, visible), where there is one; blocks without any text left go."""
    b = blocks.join(overrides.select("doc_id", "ordinal", "visible"), ["doc_id", "ordinal"], "left").withColumn("text", F.coalesce("visible", "text"))
    return b.where(F.coalesce("text", F.lit("")).rlike(r"(?U)\S")).select(*blocks.columns)


def block_ids(blocks: DataFrame) -> DataFrame:
    """PRJ-02: block_id of blocks (doc_id, format, page_index, ordinal, content_type, text): format, place, type and fingerprint; those of pages by page and ordinal."""
    docx = F.concat_ws(":", F.col("format"), F.col("ordinal").cast("string"), F.col("content_type"), fp(normalized(F.col("text"))))
    pdf = F.concat_ws(":", F.col("format"), F.col("page_index").cast("string"), F.col("ordinal").cast("string"))
    return blocks.withColumn("block_id", F.when(F.col("format") == "pdf", pdf).otherwise(docx))


def language_profile(docs: DataFrame) -> DataFrame:
    """AGG-04: han and latin letters of each doc_id's texts, and the language they tell."""
    count = lambda p: F.length("text") - F.length(F.regexp_replace("text", p, ""))
    p = docs.groupBy("doc_id").agg(F.sum(count("[㐀-鿿]")).alias("han"), F.sum(count("[A-Za-z]")).alias("latin"))
    total = F.col("han") + F.col("latin")
    kind = F.when(F.coalesce(total, F.lit(0)) == 0, "other").when((F.col("han") >= 0.2 * total) & (F.col("latin") >= 0.2 * total), "zh-en").when(F.col("han") > F.col("latin"), "zh").otherwise("en")
    return p.withColumn("language", kind)


def _blocks(paragraphs: DataFrame) -> DataFrame:
    return paragraphs if "content_type" in paragraphs.columns else paragraphs.withColumn("content_type", F.lit("paragraph"))


def labelled_fingerprints(paragraphs: DataFrame, label: str, doc: str = "doc_id") -> DataFrame:
    """(doc, fp) of the clauses with that label: only their texts are normalized, and none is exchanged."""
    c = _joined(segment(_blocks(paragraphs), doc), doc).where(F.col("label") == label).select(doc, "text")
    return c.select(doc, fp(normalized_with(F.col("text"), norm_of_others(F.col("text")))).alias("fp"))


def tree_of(paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Paragraphs (doc, ordinal, text) to the tree of their clauses, without their texts."""
    return clause_tree(_joined(segment(_blocks(paragraphs), doc), doc).select(doc, "clause_no", "level", "heading"), doc)


def outline_of(paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Paragraphs (doc, ordinal, text) to (doc, clause_no, label, level, heading, parent_no): clauses without their texts, ids and fingerprints."""
    tree = clause_tree(_joined(segment(_blocks(paragraphs), doc), doc).select(doc, "clause_no", "label", "level", "heading"), doc)
    return tree.select(doc, "clause_no", "label", "level", "heading", "parent_no")


def _of_labels(clauses: DataFrame, labels: DataFrame, doc: str) -> DataFrame:
    """The clauses whose label may be one of their document's labels (doc, label): those that cannot be, as both are ASCII and differ, go. No text is exchanged, as no Arrow function is asked."""
    wanted = labels.select(doc, F.col("label").alias("wanted")).distinct()
    same = (norm(F.col("label")) == norm(F.col("wanted"))) | ~F.col("label").rlike(ASCII) | ~F.col("wanted").rlike(ASCII)
    return clauses.alias("c").join(wanted.alias("w"), (F.col(f"c.{doc}") == F.col(f"w.{doc}")) & same, "left_semi")


def plain_clauses(paragraphs: DataFrame, doc: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """Paragraphs (doc, ordinal, text) to clauses with path and text, whose texts are not normalized."""
    tree = clause_tree(_joined(segment(_blocks(paragraphs), doc), doc), doc)
    return tree.select(*_keys(doc), "clause_no", "label", "heading", "ancestor_path", "text")


def clauses_of(paragraphs: DataFrame, doc: str = "doc_id", ids: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """Paragraphs (doc, ordinal, text) to clauses with tree and ids. Without ids, ``labels`` (doc, label) leaves those clauses that selectors of these labels can find; only their texts are normalized."""
    blocks = _blocks(paragraphs)
    if not ids:
        # Nothing groups by document after the Arrow function, so no exchange of texts follows it.
        tree = clause_tree(_joined(segment(blocks, doc), doc), doc)
        tree = (tree if labels is None else _of_labels(tree, labels, doc)).withColumn("others", norm_of_others(F.col("text")))
        return tree.withColumn("norm", normalized_with(F.col("text"), F.col("others"))).withColumn("fp", fp(F.col("norm"))).drop("others")
    # The Arrow function's step ends what is known of the rows' places, so one exchange follows it: it carries each text once, without norm and fingerprint.
    tree = clause_tree(_joined(segment(blocks, doc), doc).withColumn("others", norm_of_others(F.col("text"))), doc)
    return clause_ids(tree.withColumn("norm", normalized_with(F.col("text"), F.col("others"))).withColumn("fp", fp(F.col("norm"))).drop("others"), doc)
