"""Lines, reading order and headings against plain loops over small pages."""

import random

from revverify.operators import layout
from revverify.operators.clauses import clauses_of

WORDS = "page_id long, text string, x0 double, top double, x1 double, bottom double"


def rows_told_slowly(words):
    rows = []
    for w in sorted(words, key=lambda w: (w[3], w[2], w[1])):
        if not rows or w[3] - rows[-1][0][3] > 3:
            rows.append([])
        rows[-1].append(w)
    return rows


def line(row):
    o = sorted(row, key=lambda w: (w[2], w[3], w[1]))
    return (" ".join(w[1] for w in o), min(w[2] for w in o), min(w[3] for w in o), max(w[4] for w in o), max(w[5] for w in o))


def order_told_slowly(words, width):
    rows, middle = rows_told_slowly(words), width / 2
    votes = 0
    for row in rows:
        left, right = [w[4] for w in row if w[4] <= middle], [w[2] for w in row if w[2] >= middle]
        votes += bool(left and right and min(right) - max(left) >= width * 0.025)
    if not (len(rows) >= 8 and votes >= 8 and votes / len(rows) >= 0.6):
        return [line(r) for r in rows]
    out, sides = [], ([], [])
    for row in [*rows, None]:
        across = row is not None and any(w[2] < middle < w[4] for w in row)
        if row is None or across:
            out += [line(r) for side in sides for r in side]
            sides = ([], [])
            out += [line(row)] if across else []
            continue
        for side, words_ in zip(sides, ([w for w in row if w[4] <= middle], [w for w in row if w[2] >= middle]), strict=True):
            if words_:
                side.append(words_)
    return out


def page(rnd, number, columns):
    words = []
    for r in range(rnd.choice([3, 7, 12, 20])):
        top = 20.0 * r + rnd.choice([0, 0.5])
        if columns and rnd.random() < 0.15:
            words.append((number, f"wide{r}", 100.0, top, 480.0, top + 9))
            continue
        for c in range(rnd.choice([1, 4, 9])):
            x = (rnd.choice([30, 330]) if columns else 30) + 25.0 * c
            words.append((number, f"w{r}.{c}", x, top + rnd.choice([0, 0.9 * c, 1.5]), x + rnd.choice([15, 20]), top + 9))
    return words


def test_lines_and_reading_order(spark):
    rnd = random.Random(4)
    pages = {n: page(rnd, n, n % 3) for n in range(40)}
    pages[90] = [(90, f"z{i}", float(i), 3.0 * i, float(i) + 1, 3.0 * i + 1) for i in range(30)]  # steps of exactly 3: pairs of rows
    pages[91] = [(91, "z", 300.0, 40.0 * i, 300.0, 40.0) for i in range(3)] + [(91, s, x, 40.0 * i, x + 9, 40.0) for i in range(9) for s, x in (("l", 10.0), ("r", 400.0))]  # a word without width on the middle
    pages[92] = [(92, "same", 5.0, 5.0, 6.0, 6.0)] * 3
    words = [w for p in pages.values() for w in p]
    df = spark.createDataFrame(words, WORDS).repartition(5)
    size = spark.createDataFrame([(n, 600.0) for n in pages], "page_id long, width double")
    lines, order = layout.words_to_lines(df).collect(), layout.reading_order(df, size).collect()
    both = set()
    for n, p in pages.items():
        assert [tuple(r)[2:] for r in sorted((r for r in lines if r["page_id"] == n), key=lambda r: r["line_no"])] == [line(r) for r in rows_told_slowly(p)]
        mine = sorted((r for r in order if r["page_id"] == n), key=lambda r: r["line_no"])
        assert [tuple(r)[3:] for r in mine] == order_told_slowly(p, 600.0), n
        both |= {r["columns"] for r in mine}
    assert both == {1, 2}
    assert layout.reading_order(df.limit(0), size).count() == 0


BLOCK = "doc_id long, ordinal int, content_type string, text string, format string, page_index int, x0 double, x1 double, fill boolean"


def headings(spark, *docs, kind="docx"):
    rows = [(d, i, t if t in ("heading", "header", "table") else "paragraph", x, kind, 0 if kind == "pdf" else None, 60.0 if kind == "pdf" else None, 200.0 if kind == "pdf" else None, None) for d, blocks in enumerate(docs) for i, (t, x) in enumerate(blocks)]
    blocks = spark.createDataFrame(rows, BLOCK)
    pages = spark.createDataFrame([(d, 0, 600.0) for d in range(len(docs))], "doc_id long, page_index int, width double")
    got = layout.display_headings(blocks, clauses_of(blocks), pages).orderBy("doc_id", "heading_no").collect()
    return [[r["heading"] for r in got if r["doc_id"] == d] for d in range(len(docs))]


def p(*texts):
    return [("p", t) for t in texts]


def test_headings_begin_and_end(spark):
    notes = p("设备采购合同", "填写说明", "一、说明", "设备采购合同", "第一条 定义", "附录 B", "第二条 迟到")
    clause_first = p("设备采购合同", "填写说明", "第九条 范围", "设备采购合同", "第一条 定义")
    early_annex = p("附件", "第一条 定义", "第一条 定义", "附件 三", "第二条 迟到")
    got = headings(spark, notes, clause_first, early_annex, kind="pdf")
    assert got == [["第一条 定义"], ["第九条 范围", "第一条 定义"], ["第一条 定义"]]
    # Only paged documents have front matter.
    assert headings(spark, notes)[0] == ["一、 说明", "第一条 定义"]


def test_headings_of_each_kind(spark):
    one = p("第三章 总则", "第三章　：价款；见附表", "一、 ：付款", "（一）首付", "第一条 甲乙双方应当在收到货物之后的三十日内完成全部验收工作并且出具书面证明", "（二）补充", "1.1 地点", "总 则 说 明", "1.2 时间", "散 文 一 段", "尾")
    two = [("heading", "附 则 的 内 容"), ("header", "第八条 页眉"), ("p", "（三）子项"), ("heading", "说明。结束")]
    assert headings(spark, one, two) == [["第三章 总则", "一、 付款", "（一） 首付", "总则说明"], ["附 则 的 内 容", "（三） 子项", "说明。结束"]]


def test_title_like_by_place(spark):
    rows = [("a", "pdf", 0, 60.0, 444.0, 600.0), ("a", "pdf", 0, 60.0, 445.0, 600.0), ("a", "pdf", 0, 310.0, 524.0, 600.0), ("a", "pdf", 0, 310.0, 525.0, 600.0), ("a", "pdf", 7, 60.0, 70.0, None), ("x" * 32, "pdf", None, None, None, None), ("x" * 33, "docx", None, None, None, None), ("a:b", "docx", None, None, None, None), ("", "docx", None, None, None, None)]
    df = spark.createDataFrame([(i, False, "paragraph", *r) for i, r in enumerate(rows)], "n int, fill boolean, content_type string, text string, format string, page_index int, x0 double, x1 double, width double")
    got = [r["ok"] for r in df.select("n", layout.title_like(df["text"]).alias("ok")).orderBy("n").collect()]
    assert got == [True, False, True, False, False, True, False, False, False]
    filled = df.limit(1).selectExpr("true AS fill", "'heading' AS content_type", "text", "format", "page_index", "x0", "x1", "width")
    assert not filled.select(layout.title_like(filled["text"])).first()[0]
