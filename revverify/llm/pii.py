"""Operator 7: personal data replaced by surrogates.

Detected entities get keyed replacements of their own type and format: an e-mail address keeps its shape and top-level
domain, a phone number its punctuation and country code, an IPv4 address the digits of its octets, a card number its grouping, first digit and
check digit, an IBAN its country and check digits, a secret its alphabet, and a name its gender (by the titles
before it, if they tell one), script and number of words. Values and names are taken to their end, whatever their length: a name
is all capitalised words and initials after its title in that line, and its words are then replaced in all of the document; names without
any title in their document are not detected. Replacement depends on the key and the entity's canonical form alone, so one
entity has one surrogate in all documents (coreference).

*Collision check.* All distinct entities of the corpus are gathered (with map-side pre-aggregation) and their surrogates compared:
two entities of one surrogate, or a surrogate that is itself an entity of the corpus, make the later entity try again with the
next attempt number, among surrogates that grow longer every eight attempts, until none is left (distinctness). The few entities beyond their first attempt are the only table
that the rewriting of texts needs, and texts themselves are never shuffled for it unless that table is large.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

# Titles that tell a gender, by language.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "Don", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Lady", "Doña", "Госпожа", "Κυρία")
# And those that tell none.
NEUTRAL_TITLES = ("Dr", "Doctor", "Doktor", "Docteur", "Dra", "Doctora", "Prof", "Professor", "Professorin", "Professeur", "Profesor", "Profesora", "Mx", "Rev", "Доктор", "Профессор", "Δρ", "Καθηγητής", "Καθηγήτρια")
TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "auth")

_UPPER = r"[^\W\d_a-zß-öø-ÿа-џά-ώ]"
# An initial, or a word with apostrophes before capitals only (O'Brien, but Smith's ends before its 's).
_NAME = rf"(?:{_UPPER}\.|{_UPPER}[^\W\d_]*(?:['’]{_UPPER}[^\W\d_]*)*)"
_NAME_WORD = re.compile(_NAME)
_BLANK = r"[^\S\r\n]"
# Between the words of a name: blanks and the small words that surnames start with, a hyphen, or nothing after an initial's dot.
_SMALL = "de|del|der|den|des|di|da|das|do|dos|du|e|el|la|las|le|los|ten|ter|van|von|vom|y|zu|zum|zur|af|av|al|bin|ibn"
_GAP = rf"(?:{_BLANK}+(?:(?:{_SMALL}){_BLANK}+)*|-|(?<=\.))"
# A quoted secret ends at its quote, a bare one at white space, a quote, a bracket, a comma or a semicolon, without a sentence's last marks.
_SECRET = r"(?<=[\"'])[^\s\"']{16,}(?=[\"'])|[!#-&*+\-./0-9:=?@A-Z^_a-z~]{15,}[#-&*+\-/0-9=@A-Z^_a-z~]"
ENTITY = re.compile(
    "|".join(
        (
            rf"(?P<secret>(?i:\b(?:{'|'.join(map(re.escape, SECRET_WORDS))})\b)['\"]?\s{{0,3}}[:=]\s{{0,3}}['\"]?(?P<secret_value>{_SECRET}))",
            r"(?P<email>(?<![\w.+\-])[A-Za-z0-9_\u00c0-\u024f][\w.+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9]))",
            r"(?P<ipv4>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))",
            r"(?P<card>(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d]|-\d))",
            r"(?P<phone>(?<![\w(+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w\-])|(?<!\w)\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w))",
            rf"(?P<name>\b(?P<title>(?:{'|'.join(TITLES)})\b(?:(?:\.\s*|\s+)(?:{'|'.join(TITLES)})\b)*)(?:\.\s*|\s+)(?P<name_value>(?:(?:{_SMALL}){_BLANK}+)*{_NAME}(?:{_GAP}{_NAME})*))",
        )
    )
)
HINT = re.compile(rf"[0-9@]|[:=]\s{{0,3}}['\"]?\S{{16}}|\b(?:{'|'.join(TITLES)})\b")
_SYLLABLES = {
    "latin": ("ba be bi bo da de do fa fe ga go ha ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te ti to va ve vi za".split(), "n", "a"),
    "cyrillic": ("ба бе во га да де ва ка ла ле ли ма ме ми на не но па ра ре ри ро са се та те ти то".split(), "н", "а"),
    "greek": ("βα γα δα θε κα κο λα λε λι μα με μι να νε νο πα πε ρα ρε ρι σα σε τα τε το".split(), "ς", "α"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


class Stream:
    """Numbers that follow from the key, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\0{canonical}\0{attempt}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest()
        self.state, self.step = 0, 0

    def below(self, n: int) -> int:
        if self.state < n << 40:
            self.state = self.state << 256 | int.from_bytes(hashlib.blake2b(self.step.to_bytes(4, "big"), key=self.seed).digest()[:32], "big")
            self.step += 1
        self.state, out = divmod(self.state, n)
        return out

    def like(self, text: str) -> str:
        """Letters for letters (case kept), digits for digits, all else as it stands."""
        pick = {True: "abcdefghijklmnopqrstuvwxyz", False: "0123456789"}
        out = []
        for c in text:
            if c.isalpha():
                x = pick[True][self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(pick[False][self.below(10)] if c.isdigit() else c)
        return "".join(out)


def _script(word: str) -> str:
    if re.search("[а-яёА-ЯЁ]", word):
        return "cyrillic"
    return "greek" if re.search("[α-ωΑ-Ω]", word) else "latin"


def _word(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """A made-up name for one word of a name; its kind tells gender (given names) or that it is a surname."""
    s = Stream(key, kind, canonical, attempt)
    syllables, male, female = _SYLLABLES[_script(canonical)]
    body = "".join(syllables[s.below(len(syllables))] for _ in range(3 + attempt // 8))
    body = body.rstrip("aeioаеиоαειο") if kind == "given-f" else body
    return body + {"given-f": female, "given-m": male}.get(kind, "")


def _spread(pattern: str, digits: str) -> str:
    """The digits put in the places of the pattern's digits (and, for letters, its letters and digits); those beyond them follow."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in pattern) + "".join(it)


def _is_initial(word: str) -> bool:
    return len(word.rstrip(".")) == 1


def _initial(word: str, key: bytes) -> str:
    """Another letter for an initial. Initials are too few to be told apart by, so they are no entities of their own."""
    letters = {"latin": "ABCDEFGHIJKLMNOPRSTUVW", "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΟΠΡΣΤΥΦ"}[_script(word)].replace(word[0], "")
    return letters[Stream(key, "initial", word[0], 0).below(len(letters))] + word[1:]


def canonicals(m: re.Match) -> list[tuple[str, str]]:
    """The (kind, canonical form) pairs that a match stands for, empty if it is no entity after all."""
    kind = m.lastgroup if m.lastgroup in ("email", "ipv4", "iban", "ssn", "card", "phone") else next(k for k in ("secret", "email", "ipv4", "iban", "ssn", "card", "phone", "name") if m[k] is not None)
    text = m[kind]
    if kind == "secret":
        v = m["secret_value"]
        return [(kind, v)] if any(c.isalnum() for c in v) else []
    if kind == "email":
        local, _, domain = text.lower().rpartition("@")
        return [("local", f"{local}@{domain}"), ("domain", domain)]
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return [(kind, digits)] if luhn(digits) and len(set(digits)) > 1 else []
    if kind == "iban":
        code = text.replace(" ", "")
        return [(kind, code)] if 15 <= len(code) <= 34 and _iban_rest(code) == 1 else []
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        # With its country code or without, a number is one: its last ten digits tell it.
        return [(kind, digits[-10:])] if 7 <= len(digits) <= 15 else []
    if kind == "name":
        words = [w for w in _NAME_WORD.findall(m["name_value"]) if not _is_initial(w)]
        titles = re.findall(r"\w+", m["title"])
        gender = next(("given-m" if t in MALE_TITLES else "given-f" for t in titles if t not in NEUTRAL_TITLES), "given-n")
        return [(gender if i < len(words) - 1 else "surname", w.lower()) for i, w in enumerate(words)]
    return [(kind, text)]


def replaced(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of the surrogate, of the entity's own length at first.

    Every eight attempts the space widens (by a letter or digit; octets by their range), so that a free surrogate exists whatever the corpus holds.
    """
    s = Stream(key, kind, canonical, attempt)
    more = attempt // 8
    wider = lambda text: text + ("0" if text[-1:].isdigit() else "a") * more
    if kind == "local":
        return s.like(wider(canonical.rpartition("@")[0]))
    if kind == "domain":
        if canonical in ("example.com", "example.org", "example.net"):
            return canonical
        labels = canonical.split(".")
        keep = 2 if len(labels) > 2 and labels[-2] == "example" else 1
        return ".".join([*(s.like(x) for x in labels[: -keep - 1]), s.like(wider(labels[-keep - 1])), *labels[-keep:]])
    if kind == "ipv4":
        span = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        if more > 1:
            # Any octet; when even those do not do, numbers that no address has.
            spans = [(0, 256) if more < 8 else (256, 256 << (more - 7))] * 4
        else:
            spans = [span[len(x) if not more else 3] for x in canonical.split(".")]
        return ".".join(str(lo + s.below(hi - lo)) for lo, hi in spans)
    if kind == "card":
        body = canonical[0] + "".join(str(s.below(10)) for _ in range(len(canonical) - 2 + more))
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        body = s.like(canonical[4:] + "0" * more)
        rest = _iban_rest(f"{canonical[:2]}00{body}")
        return f"{canonical[:2]}{98 - rest:02d}{body}"
    if kind == "phone":
        return "".join(str(s.below(8) + 2 if i == 0 else s.below(10)) for i in range(len(canonical) + more))
    if kind == "ssn":
        return s.like(wider(canonical))
    if kind == "secret":
        hexa = re.fullmatch("[0-9a-f]+|[0-9A-F]+", canonical)
        if not hexa:
            return s.like(wider(canonical))
        out = "".join("0123456789abcdef"[s.below(16)] for _ in range(len(canonical) + more))
        return out.upper() if canonical.upper() == canonical else out
    return _word(key, kind, canonical, attempt)


def surrogate(m: re.Match, attempts: dict, key: bytes) -> str | None:
    """The text that takes the match's place; None leaves it as it is."""
    found = canonicals(m)
    if not found and not m["name"]:
        return None
    new = [replaced(k, c, attempts.get((k, c), 0), key) for k, c in found]
    kind, text = found[0][0] if found else "surname", m[0]
    if kind == "local":
        local, _, domain = text.rpartition("@")
        case = lambda old, x: "".join(b.upper() if a.isupper() else b for a, b in zip(old, x, strict=True)) if len(old) == len(x) else x
        return f"{case(local, new[0])}@{case(domain, new[1])}"
    if kind == "secret":
        return text[: m.start("secret_value") - m.start()] + new[0]
    if kind in ("card", "iban"):
        return _spread(text, new[0])
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        return _spread(text, digits[: max(0, len(digits) - 10)] + new[0])
    if kind in ("given-m", "given-f", "given-n", "surname"):
        made = iter(new)

        def word(w: re.Match) -> str:
            old = w[0]
            if _is_initial(old):
                return _initial(old, key)
            return next(made).upper() if old.isupper() else next(made).capitalize()

        return text[: m.start("name_value") - m.start()] + _NAME_WORD.sub(word, m["name_value"])
    return new[0]


def again(word: str, kinds: dict, attempts: dict, key: bytes) -> str | None:
    """The surrogate of a name's word that stands by itself."""
    if word.lower() not in kinds:
        return None
    kind, canonical = kinds[word.lower()]
    new = replaced(kind, canonical, attempts.get((kind, canonical), 0), key)
    return new.upper() if word.isupper() else new.capitalize()


def scan(text: str) -> list[re.Match]:
    """All matches of a text that stand for something, in order: entities, and further places of the words of its names.

    A name that a title tells once is looked for in the whole document: the same words, capitalised or all in capitals.
    """
    found = [m for m in ENTITY.finditer(text) if canonicals(m) or m["name"]]
    words = {w for m in found if m["name"] for w in _NAME_WORD.findall(m["name_value"]) if not _is_initial(w)}
    if not words:
        return found
    spans = [(m.start("name_value") if m["name"] else m.start(), m.end()) for m in found]
    again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted((re.escape(x) for w in words for x in {w, w.upper()}), key=len, reverse=True))})(?!\w)")
    more, i = [], 0
    for m in again.finditer(text):
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        if i == len(spans) or m.end() <= spans[i][0]:
            more.append(m)
    return sorted([*found, *more], key=re.Match.start)


def name_kinds(found: list[re.Match]) -> dict[str, tuple[str, str]]:
    """(kind, canonical form) of each word of a text's names, in lower case: as its first titled name tells it."""
    out: dict[str, tuple[str, str]] = {}
    for m in found:
        if m.re.groups and m["name"]:
            for kind, word in canonicals(m):
                out.setdefault(word, (kind, word))
    return out


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, kind, canonical) of all documents (doc_id, text)."""

    def run(batches):
        for batch in batches:
            out: dict[tuple, None] = {}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text and HINT.search(text):
                    for m in ENTITY.finditer(text):  # further places of names bring no new entity
                        out.update(dict.fromkeys((doc, *x) for x in canonicals(m)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "kind", "canonical"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, kind string, canonical string")


def later_attempts(found: DataFrame, key: bytes) -> DataFrame:
    """The entities (kind, canonical, attempt) whose first surrogates collide, with the attempt that does not."""

    @F.arrow_udf("string")
    def made(kind: pa.Array, canonical: pa.Array, attempt: pa.Array) -> pa.Array:
        rows = zip(kind.to_pylist(), canonical.to_pylist(), attempt.to_pylist(), strict=True)
        # An address is its local part at its domain: its surrogate is compared within the domain's old name.
        return pa.array([f"{replaced(k, c, a, key)}@{c.rpartition('@')[2]}" if k == "local" else replaced(k, c, a, key) for k, c, a in rows], pa.string())

    base = stored(found.select("kind", "canonical").distinct())
    now = base.withColumn("attempt", F.lit(0))
    while True:  # the space of surrogates widens with the attempt, so every entity finds one
        new = stored(now.withColumn("s", made("kind", "canonical", "attempt")))
        taken = new.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("c")).where("c > 1")
        lost = new.join(taken, ["kind", "s"]).where(F.struct("attempt", "canonical") != F.col("first")).select("kind", "canonical")
        # An entity that is its own surrogate, or another's, tries again; reserved domains stay.
        known = base.select("kind", F.col("canonical").alias("s"))
        lost = lost.union(new.where("NOT (kind = 'domain' AND s = canonical AND canonical LIKE 'example.%')").join(known, ["kind", "s"], "left_semi").select("kind", "canonical"))
        lost = stored(lost.distinct())
        if not lost.take(1):
            return new.where("attempt > 0").select("kind", "canonical", "attempt")
        again = lost.withColumn("again", F.lit(1))
        now = new.drop("s").join(again, ["kind", "canonical"], "left").select("kind", "canonical", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


KEY_SETTING = "spark.revverify.pii.key"
#: For the registered query, the pipeline's check and tests only: everybody can read it, so its surrogates can be recomputed.
TEST_KEY = b"test key that hides nothing"


def key_of(spark) -> bytes:
    """The secret key of this session, from its setting; without one nothing is rewritten."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key, or pass one")
    return key.encode()


def pseudonymised(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with their texts rewritten, and ``entities``: array of (kind, start, length) in characters of the old text.

    Needs doc_id and text; other columns stay, but for one named ``entities``. An empty table gives an empty one. A null text stays null with no entities; whole texts
    are read, whatever their length. Rows that repeat, ties and null ids are ordinary rows. ``key`` (by default that of the setting) must be kept secret and the same
    for runs whose surrogates shall agree.
    """
    key = key or key_of(docs.sparkSession)
    late = stored(later_attempts(stored(entities(docs)), key))
    result = "struct<text:string,entities:array<struct<kind:string,start:int,length:int>>>"

    @F.arrow_udf(result)
    def rewrite(texts: pa.Array, late_: pa.Array) -> pa.Array:
        out = []
        for text, extra in zip(texts.to_pylist(), late_.to_pylist(), strict=True):
            spans = []
            if text and HINT.search(text):
                attempts = {(x["kind"], x["canonical"]): x["attempt"] for x in extra or ()}
                parts, at = [], 0
                found = scan(text)
                kinds = name_kinds(found)
                for m in found:
                    new = surrogate(m, attempts, key) if m.re.groups else again(m[0], kinds, attempts, key)
                    if new is not None:
                        kind = "name" if not m.re.groups else next(k for k in ("secret", "email", "ipv4", "iban", "ssn", "card", "phone", "name") if m[k] is not None)
                        spans.append({"kind": kind, "start": m.start(), "length": m.end() - m.start()})
                        parts += [text[at : m.start()], new]
                        at = m.end()
                text = "".join(parts) + text[at:] if parts else text
            out.append({"text": text, "entities": spans})
        shape = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())])))])
        return pa.array(out, shape)

    names = [c for c in docs.columns if c != "entities"]
    n = late.count()
    own = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("id"))
    if n:
        per = entities(docs).join(small_side(late, n), ["kind", "canonical"])
        per = stored(per.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("late")).withColumnRenamed("doc_id", "of"))
        own = own.join(small_side(per, per.count()), F.col("id").eqNullSafe(F.col("of")), "left")
        extra = F.col("late")
    else:
        extra = F.array().cast("array<struct<kind:string,canonical:string,attempt:int>>")
    got = own.select("row", rewrite("text", extra).alias("new"))
    return got.select(*[F.col("new.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], F.col("new.entities").alias("entities"))


def op7_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its rewritten text, the number of its entities and their kinds."""
    out = pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), TEST_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return out.select("doc_id", F.size("entities").alias("n_entities"), kinds.alias("kinds"), "text")


def without_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with rewritten texts and, where they have it, n_chars to match."""
    out = pseudonymised(docs, key)
    return out.select(*[F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
