"""Protected values in clause texts: parties, currencies, money, dates, durations, percentages.

A text is scanned for a few plain *anchors*: clusters of digits, currency signs and codes, runs of Chinese numerals, dates, party labels. Each becomes a row, and what it is worth
is told by what stands next to it: a cluster with a unit of time behind it is a duration, with a currency behind it an amount, and a currency with a cluster behind it an amount too.
So a number is found once, whatever it may mean, and all values are plain columns. One scan, one explode; only the running numbers of repeats need the rows of a key together.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import MONTHS, day_of, dec_text, let, stable_id, zh_number

# Currency signs and codes, Chinese money units, scales, duration units, numerals, and the signs that decide what stands next to them.
CURRENCIES = {"RMB": "CNY", "CNY": "CNY", "¥": "CNY", "￥": "CNY", "USD": "USD", "$": "USD", "US$": "USD", "EUR": "EUR", "€": "EUR", "GBP": "GBP", "£": "GBP", "HKD": "HKD", "HK$": "HKD", "JPY": "JPY", "CHF": "CHF", "SGD": "SGD", "AUD": "AUD", "CAD": "CAD"}
ZH_CURRENCIES = {"元": "CNY", "圆": "CNY", "美元": "USD", "港元": "HKD", "港币": "HKD", "日元": "JPY", "欧元": "EUR", "英镑": "GBP"}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
ZH_SCALES = {"万": 10_000, "亿": 100_000_000}
UNITS = {"day": "day", "days": "day", "天": "day", "日": "day", "month": "month", "months": "month", "个月": "month", "月": "month", "year": "year", "years": "year", "年": "year"}
CAPITALS, CAPITAL_UNITS = "零壹贰叁肆伍陆柒捌玖", "拾佰仟万亿"
NUMERALS = "零〇一二两三四五六七八九十百千万"
PARTIES, PARTY_WORD, PARTY_LETTERS = ("甲方", "乙方", "丙方"), "Party", "AB"
AFTER_DURATION, NO_DURATION_BEFORE, NO_DURATION_AFTER, DAY_ENDS = ",.，。；;、:：)）内前后起至", "第同每某任逐", "度级", "内前后起"
RMB, ZH_PERCENT, MONTH_FORMS = "人民币", "百分之", (*MONTHS, *(m[:3] for m in MONTHS if len(m) > 3), "Sept")

KINDS = ("party", "currency", "money", "date", "duration", "percentage")
CLUSTER = r"\d+(?:[.,]\d+)*"
_ONE_OF = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))  # noqa: E731  longer ones first
_CODES = _ONE_OF(c.replace("$", "[$]") for c in CURRENCIES if len(c) > 1)
_SIGNS, _INITIALS = "".join(c for c in CURRENCIES if len(c) == 1), "".join(sorted({c[0] for c in CURRENCIES if len(c) > 1}))
_TOKEN = rf"(?:(?<![A-Za-z])(?:{_CODES})(?![A-Za-z])|[{_SIGNS}])"
_SCALE = rf"(?:\s+({_ONE_OF(SCALES)})\b)?"
_MONTH, _ORDINAL = rf"({_ONE_OF(MONTH_FORMS)})[.]?", r"(\d{1,2})(?:st|nd|rd|th)?"
_YMD = {"date.iso": r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", "date.zh": r"(?U)(?<!\d)(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日(?!\d)"}
_NAMED = {"date.mdy": rf"(?iU)\b{_MONTH}\s+{_ORDINAL},?\s+(\d{{4}})(?!\d)", "date.dmy": rf"(?iU)(?<!\d){_ORDINAL}\s+{_MONTH},?\s+(\d{{4}})(?!\d)"}
_BEHIND = rf"[)）]?\s*(?:[%{_SIGNS}{''.join(ZH_SCALES)}]|{_ONE_OF((*UNITS, *SCALES, *ZH_CURRENCIES))}|{_CODES})"
_NAMES = "(?:" + "|".join(m[:3] for m in MONTHS) + ")"
#: Anchors: kinds that they can give, a cheap test of the text, pattern.
ANCHORS = {
    "number": (("money", "currency", "duration", "percentage"), r"\d", rf"(?U){CLUSTER}"),
    "token": (("currency", "money"), rf"[{_SIGNS}]|(?i:(?<![A-Za-z])(?=[{_INITIALS}])(?:{_CODES}))", f"(?i){_TOKEN}"),
    "capital": (("money", "currency"), f"[{CAPITALS}拾].*[元圆]", f"[{CAPITALS}{CAPITAL_UNITS}]+(?=[元圆])"),
    "numeral": (("duration",), f"[{NUMERALS}](?:天|个月|年|日)", f"[{NUMERALS}]+(?=天|个月|年|日)"),
    "percent": (("percentage",), ZH_PERCENT, f"{ZH_PERCENT}[{NUMERALS}点]+"),
    "party": (("party",), f"(?i){PARTY_WORD}|{'|'.join(PARTIES)}", rf"(?iU)(?:{'|'.join(PARTIES)}|{PARTY_WORD}\s+[{PARTY_LETTERS}])(?:[（(][^）)\n\r]{{1,20}}[）)])?\s*[:：]\s*[^;；\n\r]+"),
    "date.iso": (("date",), r"\d{4}[-/.]\d", _YMD["date.iso"]),
    "date.zh": (("date",), r"\d年", _YMD["date.zh"]),
    "date.mdy": (("date",), r"(?i)[a-z]{3}[.]?\s+\d", _NAMED["date.mdy"]),
    "date.dmy": (("date",), r"(?i)\d\s*[a-z]{0,2}\s+[a-z]{3}", _NAMED["date.dmy"]),
}
_DATES = [a for a in ANCHORS if a.startswith("date")]
#: A second test of texts that pass the first: what a match needs around it to count. Most numbers have nothing behind them that makes them a value.
NEEDS = {"number": rf"(?iU)\d{_BEHIND}", "date.mdy": rf"(?iU)(?=\s+\d)(?<={_NAMES}[a-z]{{0,6}}[.]?)", "date.dmy": rf"(?iU)\d(?:st|nd|rd|th)?\s+{_NAMES}"}
# Words that a text must hold for an anchor: looked for before any pattern, which takes far longer on Chinese signs.
_WORDS = {"capital": tuple("元圆"), "numeral": ("天", "个月", "年", "日"), "percent": (ZH_PERCENT,), "party": (PARTY_WORD.lower(), *PARTIES), "date.zh": ("年",)}
_OPEN, _CLOSE = "\x01", "\x02"


def matches(text: Column, pattern: str) -> Column:
    """Array of (pos, m): matches of a pattern with their offsets.

    One sign is put before each match and one behind it, as a pattern to split at is compiled anew for every text. Signs of the text that are the same are another one for that long.
    """
    none = F.array().cast("array<struct<pos:int,m:string>>")
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "\x03\x03"), pattern, f"{_OPEN}$0{_CLOSE}")

    def step(s: Column, x: Column) -> Column:
        m = F.substr(text, s["at"] + 1, F.length(F.substring_index(x, _CLOSE, 1)))
        return F.struct((s["at"] + F.length(x) - 1).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("pos"), m.alias("m")))).alias("out"))

    return let(F.split(marked, _OPEN, -1), lambda g: F.aggregate(F.slice(g, 2, F.size(g)), F.struct(F.length(F.get(g, F.lit(0))).alias("at"), none.alias("out")), step, lambda s: s["out"]))


def anti_overlap(items: Column, spans: Column) -> Column:
    """JN-06: the items (pos, text) that overlap none of the spans (pos, text)."""
    end = lambda x: x["pos"] + F.length(x["text"])
    return F.filter(items, lambda x: ~F.exists(spans, lambda d: (x["pos"] < end(d)) & (d["pos"] < end(x))))


def _look_up(d: dict, c: Column, other: Column | None = None) -> Column:
    """The value of a key in a small fixed table."""
    out = F.when(F.lit(False), F.lit(next(iter(d.values()))))
    for value in dict.fromkeys(d.values()):
        out = out.when(c.isin(*[k for k, v in d.items() if v == value]), F.lit(value))
    return out if other is None else F.coalesce(out, other)


def _calendar_day(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(day_of(year, month, day), "yyyy-MM-dd")


def _date_value(anchor: Column, m: Column) -> Column:
    group = lambda p, i: F.regexp_extract(m, p.replace(r"(?<!\d)", "").replace(r"(?!\d)", ""), i)
    number = {m[:3].lower(): str(i + 1) for i, m in enumerate(MONTHS)}
    named = lambda p, month, day: _calendar_day(group(p, 3), let(F.lower(F.substring(group(p, month), 1, 3)), lambda name: _look_up(number, name)), group(p, day))
    out = F.when(F.lit(False), "")
    for a, p in _YMD.items():
        out = out.when(anchor == a, _calendar_day(group(p, 1), group(p, 2), group(p, 3)))
    return out.when(anchor == "date.mdy", named(_NAMED["date.mdy"], 1, 2)).otherwise(named(_NAMED["date.dmy"], 2, 1))


#: What a candidate is, and what its value is made of: a fixed value, a decimal with its scale or a Chinese numeral, and what follows it.
_FIELDS = {"kind": "string", "pos": "int", "end": "int", "plain": "string", "dec": "string", "scale": "bigint", "zh": "string", "tail": "string", "own": "string"}


def _entity(kind: str, ok: Column, start: Column, end: Column, own: Column | None = None, **value: Column) -> Column:
    """A candidate of _FIELDS (own: its text where that is not all from pos to end), null where it is none."""
    given = {"kind": F.lit(kind), "pos": start, "end": end, **value} | ({} if own is None else {"own": own})
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()]))


def _with_values(rows: DataFrame) -> DataFrame:
    """The values of candidates. A numeral must be one, also where the value is fixed, and no duration is of 0."""
    rows = rows.withColumn("v", F.when(F.col("dec").isNotNull(), dec_text(F.col("dec"), F.col("scale"))).when(F.col("zh").isNotNull(), zh_number(F.col("zh"))))
    rows = rows.where(F.col("zh").isNull() | (F.col("v").isNotNull() & ((F.col("kind") != "duration") | (F.col("v") != "0"))))
    return rows.withColumn("value", F.when(F.col("kind") == "duration", F.concat_ws(" ", "v", "tail")).otherwise(F.coalesce("plain", F.concat("v", F.coalesce("tail", F.lit(""))))))


def _only(rows: DataFrame, anchor: str, columns: dict[str, Column]) -> DataFrame:
    """Columns that only rows of one anchor have."""
    return rows.withColumns({k: F.when(F.col("anchor") == anchor, c) for k, c in columns.items()})


def _of_number(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """What a cluster of digits can be with what follows it. Of "1,2.5" only the last number is next to what follows."""
    m, after, end = F.col("m"), F.col("after"), F.col("pos") + F.length("m")
    plain, grouped = F.regexp_extract(m, r"(\d+(?:[.]\d+)?)$", 1), F.regexp_extract(m, r"(\d+(?:,\d{3})*(?:[.]\d+)?)$", 1)
    signed = F.when((F.length(grouped) == F.length(m)) & F.col("prev").isin("+", "-"), F.concat("prev", grouped)).otherwise(grouped)
    unit = F.lower(F.regexp_extract(after, rf"(?iU)^[)）]?\s*({_ONE_OF(UNITS)})(?=$|[\s{AFTER_DURATION}])", 1))
    bracket = F.regexp_extract(after, rf"(?iU)^([)）]?\s*(?:{_ONE_OF(UNITS)}))(?=$|[\s{AFTER_DURATION}])", 1)
    suffix, scale = F.regexp_extract(after, rf"(?iU)^{_SCALE}\s*({_TOKEN})", 2), F.regexp_extract(after, rf"(?iU)^{_SCALE}\s*{_TOKEN}", 1)
    money_end = F.length(F.regexp_extract(after, rf"(?iU)^{_SCALE}\s*{_TOKEN}", 0))
    zh = rf"(?U)^\s*([{''.join(ZH_SCALES)}])?({_ONE_OF(ZH_CURRENCIES)})"
    rows = _only(rows, "number", {
        "n_plain": plain, "n_amount": signed, "n_unit": unit, "n_unit_text": bracket, "n_suffix": suffix, "n_scale": F.lower(scale), "n_money_end": money_end,
        "n_zh": F.regexp_extract(after, zh, 2), "n_zh_scale": F.regexp_extract(after, zh, 1), "n_zh_end": F.length(F.regexp_extract(after, zh, 0)), "n_percent": F.length(F.regexp_extract(after, r"(?U)^\s*%(?!\d)", 0)),
    })
    # The yuan's name before an amount belongs to it, if nothing of the cluster stands between.
    at, zh_value = end - F.length("n_amount"), _look_up(ZH_CURRENCIES, F.col("n_zh"))
    own = F.length(F.regexp_extract(F.substr("text", F.lit(1), at), rf"(?U)({RMB}\s*)$", 1))
    rows = rows.withColumn("n_rmb", F.when((F.col("n_zh") != "") & (F.length("n_amount") >= F.length("m")), own).otherwise(0))
    start = at - F.col("n_rmb")
    here = F.col("anchor") == "number"
    return rows, [
        _entity("duration", here & (F.col("n_unit") != ""), end - F.length("n_plain"), end + F.length("n_unit_text"), dec=F.col("n_plain"), scale=F.lit(1), tail=_look_up(UNITS, F.col("n_unit"))),
        _entity("percentage", here & (F.col("n_percent") > 0), end - F.length("n_plain"), end + F.col("n_percent"), dec=F.col("n_plain"), scale=F.lit(1)),
        _entity("money", here & (F.col("n_suffix") != ""), at, end + F.col("n_money_end"), dec=F.col("n_amount"), scale=_look_up(SCALES, F.col("n_scale"), F.lit(1))),
        _entity("money", here & (F.col("n_zh") != ""), start, end + F.col("n_zh_end"), dec=F.col("n_amount"), scale=_look_up(ZH_SCALES, F.col("n_zh_scale"), F.lit(1))),
        _entity("currency", here & (F.col("n_zh") != ""), start, end + F.col("n_zh_end"), F.when((F.col("n_rmb") > 0) & (zh_value == "CNY"), RMB).otherwise(F.col("n_zh")), plain=zh_value),
    ]


def _of_token(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """A currency, and the amount that may follow it."""
    end = F.col("pos") + F.length("m")
    given = rf"(?U)^(\s*)([+-]?)({CLUSTER})"
    part = lambda i: F.regexp_extract("after", given, i)
    rows = _only(rows, "token", {"t_gap": F.length(part(1)) + F.length(part(2)), "t_sign": part(2), "t_cluster": part(3)})
    rows = rows.withColumn("t_amount", F.regexp_extract("t_cluster", r"^(\d+(?:,\d{3})*(?:[.]\d+)?)", 1))
    rest = F.substr("after", F.col("t_gap") + F.length("t_amount") + 1)
    rows = rows.withColumn("t_scale", F.when(F.length("t_amount") == F.length("t_cluster"), F.regexp_extract(rest, rf"(?iU)^\s+({_ONE_OF(SCALES)})\b", 0)).otherwise(""))
    here, scale = F.col("anchor") == "token", F.lower(F.regexp_extract("t_scale", "([A-Za-z]+)$", 1))
    return rows, [
        _entity("currency", here, F.col("pos"), end, plain=_look_up(CURRENCIES, F.upper("m"))),
        _entity("money", here & (F.col("t_amount") != ""), F.col("pos"), end + F.col("t_gap") + F.length("t_amount") + F.length("t_scale"), dec=F.concat("t_sign", "t_amount"), scale=_look_up(SCALES, scale, F.lit(1))),
    ]


def _of_chinese(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Amounts in capital numerals with their small change, durations and percentages in numerals."""
    end = F.col("pos") + F.length("m")
    bare = F.regexp_replace("m", f"^[{CAPITAL_UNITS.replace('拾', '')}]+", "")
    bare = F.when((F.length(bare) == F.length("m")) & F.col("prev").rlike("[0-9.]"), F.regexp_replace(F.substr(bare, F.lit(2)), f"^[{CAPITAL_UNITS.replace('拾', '')}]+", "")).otherwise(bare)
    change = f"^([元圆])(?:([{CAPITALS}])角)?(?:([{CAPITALS}])分)?(?:整|正)?"
    digit = lambda i: F.nullif(F.translate(F.regexp_extract("after", change, i), CAPITALS, "0123456789"), F.lit(""))
    rows = _only(rows, "capital", {"c_bare": bare, "c_jiao": digit(2), "c_fen": digit(3), "c_end": F.length(F.regexp_extract("after", change, 0))})
    rows = rows.withColumn("c_rmb", F.when(F.length("c_bare") == F.length("m"), F.length(F.regexp_extract("lead", rf"(?U)({RMB}\s*)$", 1))).otherwise(0))
    rows = _only(rows, "numeral", {"c_unit": F.regexp_extract("after", rf"^(天|个月|年|日(?=[{DAY_ENDS}]))(?![{NO_DURATION_AFTER}])", 1)})
    start, capital = end - F.length("c_bare") - F.col("c_rmb"), F.coalesce(F.col("c_bare") != "", F.lit(False))
    rest = F.when(F.col("c_fen").isNotNull(), F.concat(F.lit("."), F.coalesce("c_jiao", F.lit("0")), "c_fen")).when(F.col("c_jiao").isNotNull(), F.concat(F.lit("."), "c_jiao")).otherwise("")
    lasting = (F.col("anchor") == "numeral") & (F.col("c_unit") != "") & ~F.col("prev").rlike(f"[{NO_DURATION_BEFORE}]")
    return rows, [
        _entity("money", capital, start, end + F.col("c_end"), zh=F.col("c_bare"), tail=rest),
        _entity("currency", capital, start, end + F.col("c_end"), F.when(F.col("c_rmb") > 0, RMB).otherwise(F.substr("after", F.lit(1), F.lit(1))), zh=F.col("c_bare"), plain=F.lit("CNY")),
        _entity("duration", lasting, F.col("pos"), end + F.length("c_unit"), zh=F.col("m"), tail=_look_up(UNITS, F.col("c_unit"))),
        _entity("percentage", F.col("anchor") == "percent", F.col("pos"), end, zh=F.substr("m", F.lit(len(ZH_PERCENT) + 1))),
    ]


def _found(anchor: str) -> Column:
    """Matches of one anchor as array of (pos, m); none where a test fails."""
    text, (_, test, pattern) = F.col("text"), ANCHORS[anchor]
    good = text.rlike(test) & text.rlike(NEEDS[anchor]) if anchor in NEEDS else text.rlike(test)
    if anchor in _WORDS:
        good = reduce(or_, [F.contains(F.lower(text) if w.isascii() else text, F.lit(w)) for w in _WORDS[anchor]]) & good
    return F.when(good, matches(text, pattern)).otherwise(F.array().cast("array<struct<pos:int,m:string>>"))


def extract(clauses: DataFrame, keys: list[str], kinds: Iterable[str] = KINDS) -> DataFrame:
    """ENT-01 to ENT-10, WIN-04: entities (keys, kind, pos, text, value, entity_id) of rows (keys, text), of the wanted kinds.

    Dates that are no calendar days go, and so do durations that overlap a date of their text (JN-06). Money in Chinese units gives its currency too.
    """
    wanted = set(kinds)
    used = [a for a, (gives, _, _) in ANCHORS.items() if wanted & set(gives) or (a in _DATES and "duration" in wanted)]
    rows = clauses.select(*keys, "text", *[_found(a).alias(a) for a in used])
    # A date counts only if it is a calendar day; durations look at those of their text.
    days = lambda a: F.filter(F.transform(F.col(f"`{a}`"), lambda x: F.struct(F.lit(a).alias("anchor"), x["pos"].alias("pos"), x["m"].alias("m"), _date_value(F.lit(a), x["m"]).alias("day"))), lambda x: x["day"].isNotNull())
    none = F.array().cast("array<struct<anchor:string,pos:int,m:string,day:string>>")
    dates = [F.when(F.size(F.col(f"`{a}`")) > 0, days(a)).otherwise(none) for a in used if a in _DATES]
    rows = rows.withColumn("dates", F.concat(*dates) if dates else none)
    plain = lambda a: F.transform(F.col(a), lambda x: F.struct(F.lit(a).alias("anchor"), x["pos"].alias("pos"), x["m"].alias("m"), F.lit(None).cast("string").alias("day")))
    others = [plain(a) for a in used if a not in _DATES]
    rows = rows.withColumn("x", F.explode(F.concat(F.col("dates"), *others))).select(*keys, "text", "dates", "x.*")
    rows = rows.withColumn("after", F.substr("text", F.col("pos") + F.length("m") + 1)).withColumn("lead", F.substr("text", F.lit(1), F.col("pos"))).withColumn("prev", F.when(F.col("pos") > 0, F.substr("text", F.col("pos"), F.lit(1))).otherwise(""))
    rows = rows.where((F.col("anchor") != "number") | F.col("after").rlike(rf"(?iU)^{_BEHIND}"))
    of_anchor = F.when(F.lit(False), F.lit(None))
    for part, anchors in ((_of_number, {"number"}), (_of_token, {"token"}), (_of_chinese, {"capital", "numeral", "percent"})):
        if anchors & set(used):
            rows, found = part(rows)
            of_anchor = of_anchor.when(F.col("anchor").isin(*anchors), F.array(*found))
    end, party = F.col("pos") + F.length("m"), F.regexp_replace(F.regexp_extract("m", r"(?U)^[^:：]*?(?:[（(][^）)\n\r]{1,20}[）)])?\s*[:：]\s*([^;；\n\r]+)", 1), r"(?U)^\s+|\s+$", "")
    of_anchor = of_anchor.when(F.col("anchor") == "party", F.array(_entity("party", F.lit(True), F.col("pos"), end, plain=F.nullif(party, F.lit("")))))
    of_anchor = of_anchor.otherwise(F.array(_entity("date", F.col("day").isNotNull(), F.col("pos"), end, plain=F.col("day"))))
    rows = rows.select(*keys, "text", "dates", F.explode(of_anchor).alias("e")).select(*keys, "text", "dates", "e.*").where(F.col("kind").isin(*wanted))
    rows = _with_values(rows).where(F.col("value").isNotNull())
    over = F.exists("dates", lambda d: (F.col("pos") < d["pos"] + F.length(d["m"])) & (d["pos"] < F.col("end")))
    of_digits = F.substr("text", F.col("pos") + 1, F.lit(1)).rlike(r"(?U)\d")
    rows = rows.where(~((F.col("kind") == "duration") & of_digits & over))
    text = F.coalesce("own", F.substr("text", F.col("pos") + 1, F.col("end") - F.col("pos")))
    out = rows.select(*keys, "kind", "pos", text.alias("text"), "value")
    nth = F.row_number().over(W.Window.partitionBy(*keys, "kind", "value").orderBy("pos", "text"))
    return out.withColumn("entity_id", stable_id("entity", *[F.col(k).cast("string") for k in keys], F.col("kind"), F.col("value"), nth.cast("string")))


def entity_counts(entities: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-05: how often each (kind, value) stands in each key."""
    return entities.groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"))
