"""Scalar text functions as native column expressions (and Arrow functions where Spark has no equivalent)."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(c: Column) -> Column:
    """FN-01 for ASCII text: white space collapsed, trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(c, r"(?U)\s+", " ")))


@F.arrow_udf(T.StringType())
def norm_unicode(texts: pa.Array) -> pa.Array:
    """UDF-01: NFKC, white space collapsed, trimmed, case folded. For rows that are not ASCII."""
    return pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", t).replace(" ", " ").split()).casefold() for t in texts.to_pylist()], pa.string())


ASCII = r"^\p{ASCII}*$"


def normalized(c: Column) -> Column:
    """FN-01: native for ASCII rows, the Arrow function for the others."""
    return F.when(c.rlike(ASCII), norm(c)).otherwise(norm_unicode(c))


def norm_of_others(c: Column) -> Column:
    """The part of ``normalized`` that needs Python; null for ASCII rows."""
    return norm_unicode(F.when(~c.rlike(ASCII), c))


def normalized_with(c: Column, others: Column) -> Column:
    """``normalized`` of texts whose ``norm_of_others`` is there already."""
    return F.when(c.rlike(ASCII), norm(c)).otherwise(others)


@F.arrow_udf(T.DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """UDF-03: matching-block ratio of two texts."""
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def _first_common(a: str, b: str, k: int) -> int:
    """The first place in ``a`` of k signs that stand in ``b`` too, or -1."""
    if len(b) * k <= 1 << 24:  # all of b's parts at once, while they are small
        parts = {b[j : j + k] for j in range(len(b) - k + 1)}
        return next((i for i in range(len(a) - k + 1) if a[i : i + k] in parts), -1)
    return next((i for i in range(len(a) - k + 1) if a[i : i + k] in b), -1)


def _longest_common(a: str, b: str) -> tuple[int, int, int]:
    """The longest common part as difflib takes it, the first in ``a``, then in ``b``: (place in a, place in b, length).

    Its length is at least that of a common beginning or end, and what has a common part of k signs has one of k - 1, so the length is found by bisection.
    """
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most) if a[-1 - i] != b[-1 - i]), most)
    at, least, step = 0 if head >= tail else -1, max(head, tail), 1
    over = most + 1
    while least + 1 < over:
        k = min(least + step, over - 1)
        i = _first_common(a, b, k)
        if i < 0:
            over, step = k, max(1, (k - least) // 2)
        else:
            at, step = i, 2 * step if over > most else max(1, (over - k) // 2)
            least = k
    if least == 0:
        return 0, 0, 0
    if at < 0:
        at = _first_common(a, b, least)
    return at, b.find(a[at : at + least]), least


def matching_ratio(a: str, b: str, least: float = 0.0) -> float:
    """difflib's ratio without junk, from the same blocks: the longest common part, then what stands before it and after it. 0 once it cannot reach ``least``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    most = min(len(a), len(b))
    if 2.0 * most / total < least or 2.0 * sum((Counter(a) & Counter(b)).values()) / total < least:
        return 0.0
    matched, rest = 0, [(a, b)]
    while rest:
        x, y = rest.pop()
        i, j, k = _longest_common(x, y)
        parts = ((x[:i], y[:j]), (x[i + k :], y[j + k :])) if k else ()
        matched += k
        # The most that all parts can give: less where a block has split them unevenly.
        most += k + sum(min(len(p), len(q)) for p, q in parts) - min(len(x), len(y))
        if 2.0 * most / total < least:
            return 0.0
        rest += [(p, q) for p, q in parts if p and q]
    return 2.0 * matched / total


def ratio_from(least: float):
    """UDF-03 where only ratios of at least so much count: 0 for texts that cannot reach it."""

    @F.arrow_udf(T.DoubleType())
    def over(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else matching_ratio(x, y, least) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return over


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that ratio can be, from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / total)


def lev_similarity(a: Column, b: Column) -> Column:
    """FN-07, method lev: 1 - edit distance / longer length."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def fp(c: Column) -> Column:
    """FN-02: fingerprint of normalized text."""
    return F.sha2(c, 256)


def count_occ(text: Column, part: Column) -> Column:
    """FN-03: occurrences that do not overlap; none of an empty part."""
    return F.when(F.length(part) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def quoted(part: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def offsets(gaps: Column, found: Column) -> Column:
    """Array of (pos, m): matches with their offsets from 0, from the pieces between them; one pass that carries the offset along."""
    none = F.array().cast("array<struct<pos:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        pos = s["at"] + F.length(x["g"])
        return F.struct((pos + F.length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct(pos.alias("pos"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def find_spans(text: Column, part: Column) -> Column:
    """FN-04: array of (start, end) of a literal, from 0, left to right without overlap."""
    gaps = F.split(text, quoted(part), -1)
    spans = let(gaps, lambda g: F.transform(offsets(g, F.transform(F.slice(g, 2, F.size(g)), lambda x: part)), lambda x: F.struct(x["pos"].alias("start"), (x["pos"] + F.length(part)).alias("end"))))
    return F.when(F.length(part) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(spans)


def exact_replace(text: Column, before: Column, after: Column, occurrences: Column) -> Column:
    """FN-05: all occurrences replaced when there are exactly so many, else null."""
    return F.when(count_occ(text, before) == occurrences, F.replace(text, before, after))


def is_pure_replacement(base: Column, cand: Column, before: Column, after: Column, occurrences: Column) -> Column:
    """FN-06: the candidate is the baseline with just the counted occurrences replaced."""
    left = F.when(F.contains(after, before), F.lit(True)).otherwise(count_occ(cand, before) == 0)
    return F.coalesce((before != after) & (exact_replace(base, before, after, occurrences) == cand) & left & (count_occ(cand, after) == occurrences + count_occ(F.replace(base, before, F.lit("")), after)), F.lit(False))


def stable_id(prefix: str, *cols: Column) -> Column:
    """FN-09: prefix and 24 hex digits of the parts' digest."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\0", *cols), 256), 1, 24))


def canon(**cols: Column) -> Column:
    """FN-08: compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(cols.items())]), {"ignoreNullFields": "false"})


#: A number with its inner points and commas.
NUMBER = r"\d+(?:[.,]\d+)*"


def has_context(anchor: Column) -> Column:
    """FN-11: at least six letters outside numbers."""
    return F.length(F.regexp_replace(F.regexp_replace(anchor, NUMBER, ""), r"[^\p{L}]", "")) >= 6


def generalized(anchor: Column) -> Column:
    """FN-10: numbers made one sign."""
    return F.regexp_replace(anchor, NUMBER, "#")


def stable_anchor_occurrences(anchor: Column, text: Column) -> Column:
    """FN-10: of the places where the text reads as the anchor but for numbers, those with exactly one other number of the same shape; null when a place
    differs in more or in shape, 0 without numbers in the anchor or too few letters.

    The anchor's literal parts, quoted, with a number between them make the pattern; its matches' numbers are compared with the anchor's one by one.
    """
    pattern = F.concat(F.lit("\\Q"), F.regexp_replace(F.replace(anchor, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), NUMBER, r"\\E" + NUMBER.replace("\\", "\\\\") + r"\\Q"), F.lit("\\E"))
    own = F.regexp_extract_all(anchor, F.lit(NUMBER), F.lit(0))
    shape = lambda x: F.regexp_replace(x, r"\d", "#")

    def edits(place: Column) -> Column:
        """Numbers that differ in one place; 2 stands for any that the rule does not allow."""
        theirs = F.regexp_extract_all(place, F.lit(NUMBER), F.lit(0))
        other = F.filter(F.zip_with(own, theirs, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"])
        return F.when(F.size(other) <= 1, F.when(F.exists(other, lambda x: shape(x["a"]) != shape(x["b"])), 2).otherwise(F.size(other))).otherwise(2)

    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), edits)
    total = let(found, lambda n: F.when(F.exists(n, lambda x: x > 1), F.lit(None)).otherwise(F.aggregate(n, F.lit(0), lambda s, x: s + x)))
    usable = anchor.rlike(NUMBER) & has_context(anchor) & (F.length(anchor) <= 4096) & (F.length(text) <= 32768)
    return F.when(usable, total).otherwise(0)


def sentences(text: Column, language: str = "en") -> Column:
    """FN-13: split after . or ; and white space; Chinese after each 。 or ；, which stays."""
    if language == "zh":
        return F.regexp_extract_all(text, F.lit("[^。；]*[。；]|[^。；]+$"), F.lit(0))
    return F.split(F.btrim(text), r"(?<=[.;])\s+")


def inc_first(text: Column) -> Column:
    """FN-14: the first run of digits plus one."""
    head, number = F.regexp_extract(text, r"^(\D*)(\d{1,18})", 1), F.regexp_extract(text, r"^(\D*)(\d{1,18})", 2)
    return F.when(number != "", F.concat(head, (number.cast("decimal(20,0)") + 1).cast("string"), F.substr(text, F.length(head) + F.length(number) + 1)))


# English months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers as text; null for no calendar day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def shift_date(text: Column) -> Column:
    """FN-15: a date (2026-09-03, 2026年9月3日, September 3, 2026) a day later, at the month's end a day earlier; form and width of the day stay.

    What is no calendar day has its first number raised by one.
    """
    group = lambda p, i: F.regexp_extract(text, p, i)
    iso, zh, en = r"^(\d{4}-\d{1,2}-)(\d{1,2})()$", "^(\\d{4}年\\d{1,2}月)(\\d{1,2})(日)$", rf"^((?:{'|'.join(MONTHS)}) )(\d{{1,2}})(, \d{{4}})$"
    part = lambda i: F.concat(group(iso, i), group(zh, i), group(en, i))

    def with_day(p: Column) -> Column:
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(p["head"], "^([A-Z][a-z]+)", 1))
        year = F.when(named > 0, F.regexp_extract(p["tail"], r"(\d{4})", 1)).otherwise(F.regexp_extract(p["head"], r"^(\d{4})", 1))
        month = F.when(named > 0, named.cast("string")).otherwise(F.regexp_extract(p["head"], r"^\d{4}[-年](\d{1,2})", 1))
        return let(day_of(year, month, p["old"]), lambda d: shifted(p["head"], p["old"], p["tail"], d))

    def shifted(head: Column, old: Column, tail: Column, d: Column) -> Column:
        new = F.dayofmonth(F.when(d == F.last_day(d), F.date_add(d, -1)).otherwise(F.date_add(d, 1))).cast("string")
        return F.when(d.isNull(), inc_first(text)).otherwise(F.concat(head, F.lpad(new, F.greatest(F.length(old), F.length(new)), "0"), tail))

    return F.when(text.isNotNull(), let(F.struct(*[part(i).alias(k) for i, k in enumerate(("head", "old", "tail"), 1)]), with_day))


def shift_value(text: Column, kind: Column) -> Column:
    """FN-16: days + 15, percent + 1, money + 1000 with commas kept."""
    number = F.regexp_replace(F.regexp_extract(text, r"(\d[\d,]*)", 1), ",", "").cast("long")
    new = F.when(kind == "duration", number + 15).when(kind == "percentage", number + 1).otherwise(number + 1000)
    shown = F.when(F.contains(text, F.lit(",")), F.format_number(new, 0)).otherwise(new.cast("string"))
    digits = F.regexp_extract(text, r"(\d[\d,]*)", 1)
    at = F.instr(text, digits)
    return F.concat(F.substr(text, F.lit(1), at - 1), shown, F.substr(text, at + F.length(digits)))


def around(text: Column, value: Column) -> tuple[Column, Column]:
    """What stands before the first place of a value, and after it."""
    at = F.instr(text, value)
    return F.substr(text, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substr(text, at + F.length(value))


def anchor_words(text: Column, value: Column) -> Column:
    """FN-17: the six words before the value, or the six after it where fewer than three stand before."""
    words = lambda c: F.filter(F.split(F.btrim(c), r"\s+"), lambda w: w != "")
    before, after = (words(x) for x in around(text, value))
    last = F.when(F.size(before) > 6, F.slice(before, F.size(before) - 5, F.lit(6))).otherwise(before)
    return F.array_join(F.when(F.size(before) >= 3, last).otherwise(F.slice(after, 1, 6)), " ")


def latin1_safe(text: Column) -> Column:
    """FN-20: typographic signs spelled plainly, what Latin-1 lacks as a question mark."""
    plain = F.replace(F.translate(text, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))
    return F.regexp_replace(plain, r"[^\x00-\xFF]", "?")


def wilson(s: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """FN-18: Wilson interval; (0, 0) for n = 0."""
    p, d = s / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def clause_bucket(n: Column) -> Column:
    """FN-19."""
    return F.when(n < 1000, "<1k").when(n < 2000, "1-2k").when(n < 5000, "2-5k").otherwise(">5k")


def uri_facts(uri: Column) -> Column:
    """FN-21: scheme, digest of the host, digest of the whole target."""
    scheme, host = F.regexp_extract(uri, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.struct(F.lower(scheme).alias("scheme"), F.sha2(F.lower(host), 256).alias("host_sha256"), F.sha2(uri, 256).alias("target_sha256"))


def latin1_replaced(text: Column) -> Column:
    """FN-20: how many signs latin1_safe replaces by a question mark."""
    return F.regexp_count(F.replace(F.translate(text, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("...")), F.lit(r"[^\x00-\xFF]"))


def scrub(text: Column, app: str = "revverify") -> Column:
    """FN-23: paths of temporary folders in warnings made one sign: those with a folder that is named after the application and its verify or visual step, with what lies in it."""
    slash, name = r"[\\/]", r"[^\\/\"']+"
    return F.regexp_replace(text, rf"(?:[A-Za-z]:)?(?:{slash}{name})*{slash}\Q{app}\E-(?:verify|visual)-{name}(?:{slash}{name})*", "<temporary>")


def restated(text: Column, value: Column) -> Column:
    """FN-17, guard: an opening bracket before the value or after it says that words tell it too, as in "a month (30 days)" or "$5 (five)"."""
    before, after = around(text, value)
    return F.endswith(F.regexp_replace(before, r"(?U)\s+$", ""), F.lit("(")) | F.startswith(F.regexp_replace(after, r"(?U)^\s+", ""), F.lit("("))


def basename(path: Column) -> Column:
    """FN-23: last part of a path of either slash."""
    return F.element_at(F.filter(F.split(path, r"[/\\]"), lambda x: x != ""), -1)


def dec_text(text: Column, scale: Column) -> Column:
    """FN-24: a decimal times a power of ten as text: commas and plus sign dropped, leading zeros too, the source's fraction digits kept; null beyond 38 digits."""

    def padded(p: Column) -> Column:
        places, whole = p["places"], p["whole"]
        w = F.lpad(whole, F.greatest(F.length(whole), places + 1), "0")
        return F.when(places == 0, whole).otherwise(F.concat(F.substr(w, F.lit(1), F.length(w) - places), F.lit("."), F.substr(w, F.length(w) - places + 1)))

    def of(plain: Column) -> Column:
        whole = F.try_multiply(F.replace(plain, F.lit("."), F.lit("")).try_cast("decimal(38,0)"), scale.cast("decimal(16,0)")).try_cast("decimal(38,0)").cast("string")
        return let(F.struct(F.length(F.regexp_extract(plain, r"\.(\d+)$", 1)).alias("places"), whole.alias("whole")), padded)

    return F.when(text.isNotNull(), F.concat(F.when(F.contains(text, F.lit("-")), "-").otherwise(""), let(F.regexp_replace(text, "[,+-]", ""), of)))


# Chinese digits and units.
ZH_DIGITS = {c: i for i, pair in enumerate(("零〇", "一壹", "二贰两", "三叁", "四肆", "五伍", "六陆", "七柒", "八捌", "九玖")) for c in pair}
ZH_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "万": 10_000, "亿": 100_000_000}
_SIGNS = {**{c: str(d) for c, d in ZH_DIGITS.items()}, "十": "T", "拾": "T", "百": "H", "佰": "H", "千": "K", "仟": "K", "万": "W", "亿": "Y"}


def zh_number(text: Column) -> Column:
    """FN-25: a Chinese numeral as decimal text: units up to 亿, a fraction after 点 kept digit by digit; null for other signs, for year spellings (digits
    side by side, but for a zero after a unit) and beyond 18 digits.

    Digits and units become one plain letter each; a fold over them keeps what stands before 亿, before 万, the section and the open digit.
    """
    plain = F.translate(text, "".join(_SIGNS), "".join(_SIGNS.values()))
    whole, fraction = F.substring_index(plain, "点", 1), F.when(F.contains(plain, F.lit("点")), F.substr(plain, F.length(F.substring_index(plain, "点", 1)) + 2))
    cut = lambda a, b, c, d: F.struct(*[x.cast("long").alias(n) for n, x in zip(("total", "wan", "section", "digit"), (a, b, c, d), strict=True)])
    zero = F.lit(0)

    def step(s: Column, c: Column) -> Column:
        open_, here = F.when(s["digit"] < 0, 0).otherwise(s["digit"]), s["section"] + F.when(s["digit"] < 0, 0).otherwise(s["digit"])
        unit = F.when(c == "T", 10).when(c == "H", 100).otherwise(1000)
        return (
            F.when(c.between("0", "9"), cut(s["total"], s["wan"], s["section"], c.try_cast("long")))
            .when(c.isin("T", "H", "K"), cut(s["total"], s["wan"], s["section"] + F.greatest(open_, F.lit(1)) * unit, F.lit(-1)))
            .when(c == "W", cut(s["total"], s["wan"] + F.try_multiply(here, F.lit(10_000)), zero, F.lit(-1)))
            .otherwise(cut(F.try_multiply(F.try_add(s["total"], F.try_add(s["wan"], here)), F.lit(100_000_000)), zero, zero, F.lit(-1)))
        )

    start = cut(zero, zero, zero, F.lit(-1))
    value = F.aggregate(F.filter(F.split(whole, ""), lambda c: c != ""), start, step, lambda s: s["total"] + s["wan"] + s["section"] + F.greatest(s["digit"], F.lit(0)))
    good = whole.rlike("^[0-9THKWY]*$") & ~whole.rlike("[1-9][0-9]|[0-9]0[0-9]|^0[0-9]") & (fraction.isNull() | fraction.rlike("^[0-9]+$"))
    text_of = lambda v: F.when(v.isNotNull(), F.concat_ws(".", v.cast("string"), fraction))
    return F.when(good & (F.length(plain) <= 40), let(value, text_of))
