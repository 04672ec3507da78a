"""Queries of links between a document and its rendering, and of edits chosen for contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import links, targets
from .operators.clauses import clauses_of
from .plans.materialize import kept
from .queries import MARKER_SQL, SEG_SQL
from .registry import named, query
from .sources.corpus import PARAGRAPHS_SQL, ZH_PARAGRAPHS_SQL, contract_paragraphs, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rendering(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines of the documents as logical blocks, and a rendering of them: by the place of a line it is lost, misread in one sign, cut a little or much, without a page, or there twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.translate("line", UPPER, LOWER), r"[^\x20-\x7E]", "~"), " +", " "))  # the SQL's edit distance counts bytes
    logical = docs.select("doc_id", "ordinal", norm.alias("norm")).where("norm <> ''")
    h, n = (F.col("doc_id") * 7 + F.col("ordinal") * 13) % 12, F.length("norm")
    half = F.floor(n / 2).cast("int")
    seen = F.when(h == 1, F.concat(F.substr("norm", F.lit(1), half), F.lit("#"), F.substr("norm", half + 2)))
    seen = seen.when(h == 2, F.substr("norm", F.lit(1), n - 1 - F.floor(n / 200).cast("int"))).when(h == 3, F.substr("norm", F.lit(1), n - F.floor(n / 10).cast("int"))).otherwise(F.col("norm"))
    copies = F.when(h == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    r = logical.where(h != 0).select("doc_id", (F.col("ordinal") * 2).alias("o"), seen.alias("norm"), F.when(h != 4, F.floor(F.col("ordinal") / 40).cast("int")).alias("page_index"), F.explode(copies).alias("copy"))
    y = (F.col("o") % 80 * 8).cast("double")
    return logical, r.select("doc_id", (F.col("o") + F.col("copy")).alias("ordinal"), "norm", "page_index", F.lit(40.0).alias("x0"), y.alias("y0"), (40.0 + F.length("norm")).alias("x1"), (y + 8).alias("y1")).where("norm <> ''")


RENDER_SQL = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM documents WHERE text IS NOT NULL),
logical AS (SELECT * FROM (SELECT doc_id, ordinal::INTEGER AS ordinal, trim(regexp_replace(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[^\\x20-\\x7E]', '~', 'g'), ' +', ' ', 'g'), ' ') AS norm FROM lines) WHERE norm <> ''),
shown AS (SELECT doc_id, ordinal * 2 AS o, (doc_id * 7 + ordinal * 13) % 12 AS h, length(norm) AS n, norm FROM logical),
rendered AS (
  SELECT doc_id, o + copy AS ordinal, norm, CASE WHEN h <> 4 THEN (o // 2) // 40 END AS page_index, 40.0::DOUBLE AS x0, (o % 80 * 8)::DOUBLE AS y0, (40 + length(norm))::DOUBLE AS x1, (o % 80 * 8 + 8)::DOUBLE AS y1 FROM (
    SELECT doc_id, o, h, unnest(CASE h WHEN 5 THEN [0, 1] ELSE [0] END) AS copy,
      CASE h WHEN 1 THEN left(norm, n // 2) || '#' || substr(norm, n // 2 + 2) WHEN 2 THEN left(norm, n - 1 - n // 200) WHEN 3 THEN left(norm, n - n // 10) ELSE norm END AS norm FROM shown WHERE h <> 0) WHERE norm <> ''),
-- Every line with every line of the other side. Where texts differ by signs replaced or by a part cut off, what matches is the longer one without the edits.
pairs AS (
  SELECT l.doc_id, l.ordinal AS l, r.ordinal AS r, 2.0 * (greatest(length(l.norm), length(r.norm)) - CASE WHEN l.norm = r.norm THEN 0 WHEN 100 * least(length(l.norm), length(r.norm)) < 96 * greatest(length(l.norm), length(r.norm)) THEN 1000000 ELSE levenshtein(l.norm, r.norm) END) / (length(l.norm) + length(r.norm)) AS similarity
  FROM logical l JOIN rendered r USING (doc_id)),
near AS (SELECT *, count(*) OVER (PARTITION BY doc_id, l) AS of_l, count(*) OVER (PARTITION BY doc_id, r) AS of_r FROM pairs WHERE similarity >= 0.98),
link AS (SELECT n.doc_id, n.l, n.r, n.similarity, page_index, x0, y0, x1, y1 FROM near n JOIN rendered ON rendered.doc_id = n.doc_id AND rendered.ordinal = n.r WHERE of_l = 1 AND of_r = 1 AND page_index IS NOT NULL),
found AS (SELECT a.doc_id, a.ordinal, k.r AS rendered, k.similarity, k.page_index, k.x0, k.y0, k.x1, k.y1, (SELECT count(*) FROM near WHERE near.doc_id = a.doc_id AND near.l = a.ordinal) AS eligible FROM logical a LEFT JOIN link k ON k.doc_id = a.doc_id AND k.l = a.ordinal)"""


@query(f"WITH {RENDER_SQL} SELECT doc_id, ordinal, rendered, round(similarity, 9) AS similarity, page_index, x0, y0, x1, y1, eligible FROM found")
def jn_link_rendered(spark, sf_dir):
    """JN-11: lines of the documents linked to their rendering."""
    return links.link_rendered(*rendering(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH {RENDER_SQL}, a AS (SELECT doc_id, count(*) AS blocks, count(rendered) AS linked FROM found GROUP BY 1), b AS (SELECT doc_id, count(*) AS rendered FROM rendered GROUP BY 1)
SELECT doc_id, coalesce(blocks, 0) AS blocks, coalesce(linked, 0) AS linked, coalesce(rendered, 0) AS rendered, coalesce(linked, 0) < coalesce(blocks, 0) OR coalesce(linked, 0) < coalesce(rendered, 0) AS incomplete FROM a FULL JOIN b USING (doc_id)""")
def jn_link_status(spark, sf_dir):
    """JN-11: documents whose links are incomplete."""
    logical, rendered = rendering(spark, sf_dir)
    return links.link_status(links.link_rendered(logical, rendered), rendered)


def drafted_paragraphs(spark, sf_dir, language: str = "en") -> DataFrame:
    """The contracts with their payment and fee paragraphs told anew by the remainder of their number by 8, so that every test of WIN-17 rejects some value; two more paragraphs for the last two."""
    p = contract_paragraphs(spark, sf_dir, language)
    k, o, text = F.col("contract_id") % 8, F.col("ordinal"), F.col("text")
    if language == "zh":
        new = F.when((o == 6) & (k % 2 == 0), F.concat(F.lit("利率为 "), (1 + k).cast("string"), F.lit("% 每月 计算。"))).otherwise(text)
        return p.withColumn("text", new)
    days = 15 + F.col("contract_id") % 60
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    four = (
        F.when(k == 1, say(text, " The same holds within ", days, " days of notice.")).when(k == 2, say("The Customer shall pay each undisputed invoice within a term (", days, " days) of receipt."))
        .when(k == 3, say(text, " A reminder may follow after ", days + 15, " days.")).when(k == 4, say("The fee falls due in ", days, " days. The fee falls due in full.")).when(k.isin(5, 7), "The Customer shall pay on receipt.").otherwise(text)
    )
    six = F.when(k == 1, say("The monthly fee is $", F.format_number(F.col("contract_id") * 17, 0), ". Late payments accrue.")).when(k >= 4, "No fee is due.").otherwise(text)
    p = p.withColumn("text", F.when(o == 4, four).when(o == 6, six).otherwise(text))
    ids = p.select("contract_id").distinct()
    more = ids.where(k == 6).select("contract_id", F.posexplode(F.array(F.lit("Article II Payment Terms"), F.lit("The Customer shall pay each undisputed invoice within reason."))).alias("n", "text"))
    more = more.union(ids.where(k == 7).select("contract_id", F.lit(0), F.lit("9.9 77 days")))
    return p.unionByName(more.select("contract_id", (1000 + F.col("n")).alias("ordinal"), "text"))


_EN_DRAFT = """para AS (SELECT contract_id, ordinal, CASE
  WHEN ordinal = 4 THEN CASE k WHEN 1 THEN text || ' The same holds within ' || days || ' days of notice.' WHEN 2 THEN 'The Customer shall pay each undisputed invoice within a term (' || days || ' days) of receipt.' WHEN 3 THEN text || ' A reminder may follow after ' || (days + 15) || ' days.'
    WHEN 4 THEN 'The fee falls due in ' || days || ' days. The fee falls due in full.' WHEN 5 THEN 'The Customer shall pay on receipt.' WHEN 7 THEN 'The Customer shall pay on receipt.' ELSE text END
  WHEN ordinal = 6 THEN CASE WHEN k = 1 THEN 'The monthly fee is $' || format('{:,}', contract_id * 17) || '. Late payments accrue.' WHEN k >= 4 THEN 'No fee is due.' ELSE text END ELSE text END AS text
  FROM (SELECT *, contract_id % 8 AS k, 15 + contract_id % 60 AS days FROM plain)
  UNION ALL SELECT contract_id, 1000, 'Article II Payment Terms' FROM plain WHERE ordinal = 0 AND contract_id % 8 = 6
  UNION ALL SELECT contract_id, 1001, 'The Customer shall pay each undisputed invoice within reason.' FROM plain WHERE ordinal = 0 AND contract_id % 8 = 6
  UNION ALL SELECT contract_id, 1000, '9.9 77 days' FROM plain WHERE ordinal = 0 AND contract_id % 8 = 7)"""
_ZH_DRAFT = "para AS (SELECT contract_id, ordinal, CASE WHEN ordinal = 6 AND contract_id % 8 % 2 = 0 THEN '利率为 ' || (1 + contract_id % 8) || '% 每月 计算。' ELSE text END AS text FROM plain)"
# A value's places as FN-16 and FN-17 describe them; the tests in the order in which they reject.
_PLACES = r"""
cl AS (SELECT contract_id, clause_no, string_agg(text, chr(10) ORDER BY ordinal) AS text, coalesce(min_by(coalesce(printed, ''), ordinal), '') AS label, min_by(text, ordinal) AS first, min_by(scheme, ordinal) AS scheme FROM seg GROUP BY 1, 2),
cls AS (SELECT *, CASE WHEN clause_no = 0 THEN '' ELSE trim(substr(first, length(label) + 1)) END AS heading, lower(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM cl),
ups AS (SELECT *, CASE WHEN scheme = 'decimal' THEN coalesce(last_value(CASE WHEN scheme <> 'decimal' THEN heading END IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY clause_no), '') ELSE '' END AS up FROM cls),
whole AS (SELECT contract_id, string_agg(text, chr(10) ORDER BY ordinal) AS doc FROM para GROUP BY 1),
vals AS (SELECT u.*, doc, unnest([0, 1, 2]) AS kind_no, unnest([regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\d+ (?:days|months|years))\b', 1), regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\d+(?:\.\d+)?%)', 1), regexp_extract_all(text, '\$\s?(?:\d{1,3}(?:,\d{3})+|\d+)')]) AS vs FROM ups u JOIN whole USING (contract_id)),
val AS (SELECT * EXCLUDE (vs), unnest(list_distinct(vs)) AS before FROM vals),
cut AS (SELECT *, strpos(text, before) AS pos, left(text, strpos(text, before) - 1) AS pre, substr(text, strpos(text, before) + length(before)) AS post, replace(regexp_extract(before, '(\d[\d,]*)', 1), ',', '')::BIGINT AS num FROM val),
new AS (SELECT *, CASE kind_no WHEN 0 THEN replace(before, num::VARCHAR, (num + 15)::VARCHAR) WHEN 1 THEN (num + 1) || substr(before, length(num::VARCHAR) + 1) ELSE '$' || CASE WHEN contains(before, ',') THEN format('{:,}', num + 1000) ELSE (num + 1000)::VARCHAR END END AS after,
  CASE WHEN len(regexp_extract_all(pre, '\S+')) >= 3 THEN array_to_string(regexp_extract_all(pre, '\S+')[-6:], ' ') ELSE array_to_string(regexp_extract_all(post, '\S+')[:6], ' ') END AS anchor FROM cut),
count1 AS (SELECT *, (length(text) - length(replace(text, before, ''))) // length(before) AS again, (length(doc) - length(replace(doc, before, ''))) // length(before) AS total,
  CASE WHEN anchor = '' THEN 0 ELSE (length(norm) - length(replace(norm, lower(anchor), ''))) // length(anchor) END AS found FROM new),
twins AS (SELECT c.contract_id, c.clause_no, c.before, count(*) AS matches FROM count1 c JOIN ups t ON t.contract_id = c.contract_id AND lower(t.label) = lower(c.label) AND lower(t.heading) = lower(c.heading) AND t.up = c.up
  WHERE c.anchor <> '' AND (length(t.norm) - length(replace(t.norm, lower(c.anchor), ''))) // length(c.anchor) = 1 GROUP BY ALL),
places AS (SELECT c.*, CASE WHEN regexp_matches(pre, '\(\s*$') OR regexp_matches(post, '^\s*\(') THEN 'restated' WHEN again <> 1 OR total <> 1 THEN 'target-repeats' WHEN contains(doc, after) THEN 'new-value-present' WHEN anchor = '' THEN 'no-anchor' WHEN found <> 1 THEN 'anchor-repeats'
  WHEN coalesce(matches, 0) <> 1 THEN 'clause-ambiguous' END AS rejected FROM count1 c LEFT JOIN twins USING (contract_id, clause_no, before)),
turn AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY clause_no, kind_no, pos) AS place_no FROM places)"""
_CHOOSE = r"""
good AS (SELECT * FROM turn WHERE rejected IS NULL QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY place_no) = 1),
tried AS (SELECT contract_id, bool_or(coalesce(rejected, '') IN ('', 'no-anchor', 'anchor-repeats', 'clause-ambiguous')) AS unique_one FROM turn GROUP BY 1)
SELECT w.contract_id, before, after, (SELECT min(ordinal) FROM para p WHERE p.contract_id = w.contract_id AND contains(p.text, before))::INTEGER AS paragraph, label, heading, anchor,
  length(regexp_replace(regexp_replace(anchor, '\d+(?:[.,]\d+)*', '', 'g'), '[^\p{L}]', '', 'g')) >= 6 AS context, CASE WHEN before IS NULL THEN CASE WHEN unique_one THEN 'no-unique-anchor' ELSE 'no-unique-target' END END AS reason
FROM whole w LEFT JOIN good g ON g.contract_id = w.contract_id LEFT JOIN tried s ON s.contract_id = w.contract_id"""


def _draft_sql(language: str) -> str:
    plain, draft = (PARAGRAPHS_SQL, _EN_DRAFT) if language == "en" else (ZH_PARAGRAPHS_SQL, _ZH_DRAFT)
    return f"WITH {plain.replace('para AS (', 'plain AS (')}, {draft}, {MARKER_SQL}, {SEG_SQL}, {_PLACES}"


def _chosen(language: str):
    def run(spark, sf_dir):
        p = kept(drafted_paragraphs(spark, sf_dir, language))
        return targets.choose_edit(p, kept(clauses_of(p, "contract_id", ids=False)))

    return run


def _places(language: str):
    def run(spark, sf_dir):
        p = kept(drafted_paragraphs(spark, sf_dir, language))
        places = targets.first_places(targets.edit_places(p, kept(clauses_of(p, "contract_id", ids=False))))
        return places.select("contract_id", "place_no", "clause_no", "kind", "before", "after", "anchor", "rejected")

    return run


_SHOWN = """SELECT contract_id, place_no::INTEGER AS place_no, clause_no, ['duration', 'percentage', 'money'][kind_no + 1] AS kind, before, after, anchor, rejected FROM turn t
WHERE place_no <= coalesce((SELECT min(place_no) FROM turn g WHERE g.contract_id = t.contract_id AND g.rejected IS NULL), 999)"""
for _language, _prefix in (("en", ""), ("zh", "zh_")):
    named(f"win_{_prefix}choose_edit", f"WIN-17, FN-11, FN-16, FN-17: the first viable edit of each contract ({_language}), or why it has none.", f"{_draft_sql(_language)}, {_CHOOSE}", _chosen(_language))
    named(f"win_{_prefix}edit_places", f"WIN-17: the values tried for each contract ({_language}), with what rejected them.", f"{_draft_sql(_language)} {_SHOWN}", _places(_language))
