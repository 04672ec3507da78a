"""Operator 7 on planted entities of any length, and on address spaces that the corpus fills."""

import random
import re
import string

from revverify.llm import pii

DOC = "doc_id long, text string"


def test_no_part_of_an_entity_stays(spark):
    rnd = random.Random(1)
    text = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    cases = []  # (text, pieces that must go, what must stay)
    for n in (16, 100, 511, 512, 513, 1000, 5000):
        v = text(n, alnum)
        cases.append((f"token = {v} end", [v[i : i + 12] for i in range(0, n - 11, 12)], "token = "))
        jwt = ".".join(text(n, alnum) for _ in range(3))
        cases.append((f'"auth": "{jwt}=="; more', [p[:14] for p in jwt.split(".")], "=="))
    cases.append(("password: correcthorsebatterystaple.", ["correct", "staple"], "."))
    cases.append(('secret = "ab,cd;ef(gh)klmnop12"', ["ab,cd", "klmnop"], '"'))
    for n in (1, 64, 65, 66, 300):
        local = text(n, string.ascii_lowercase)
        cases.append((f"mail {local}@{'sub.' * (n // 6)}corp.com now", [f"{local}@", "sub", "corp"], ".com now"))
    for title in ("Señora", "Mr.", "Dr", "Dr.", "Prof. Dr.", "Herr Dr.", "Mr. ", "Frau "):
        for name in ("Ana María López García", "Smith", "Zoe Quill Xenia Yolanda Ulrich Kappa", "O'Brien", "Ludwig van Beethoven", "J. Smith", "J.R.R. Tolkien", "Anna J Weber-Lang"):
            cases.append((f"so {title} {name} said", [w for w in re.findall(r"[^\W\d_]{2,}", name) if w != "van"], title.strip()))
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], DOC)
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, pii.TEST_KEY).collect()}
    for i, (old, gone, stays) in enumerate(cases):
        assert not [p for p in gone if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", out[i]) or len(p) > 9 and p in out[i]], (old[:80], out[i][:80])
        assert stays in out[i] and old[-1] == out[i][-1]
    assert re.search(r"Mr\. ([A-Z])\. \w+ said", next(out[i] for i, c in enumerate(cases) if c[0] == "so Mr. J. Smith said"))[1] != "J"
    # One person, with and without a possessive, is one person.
    two = spark.createDataFrame([(1, "Dr. Weber"), (2, "Prof. Weber's dog")], DOC)
    a, b = (r["text"] for r in pii.pseudonymised(two, pii.TEST_KEY).orderBy("doc_id").collect())
    assert b == f"Prof. {a.split()[1]}'s dog"


def test_full_address_spaces_find_surrogates(spark):
    letters = string.ascii_lowercase
    local = [f"{c}@full.org" for c in letters + string.digits]
    domain = [f"someone.else@{a}{b}.com" for a in letters for b in letters]
    docs = spark.createDataFrame(list(enumerate(local + domain)), DOC)
    new = [r["text"] for r in pii.pseudonymised(docs, pii.TEST_KEY).collect()]
    assert len(set(new)) == len(new) == 36 + 676
    assert not {t.split("@")[0] for t in new[:36]} & set(letters + string.digits) and not {t.split("@")[1] for t in new} & {t.split("@")[1] for t in local + domain}


def test_every_kind_widens():
    for kind, canonical in [("local", "_@a.com"), ("domain", "-.com"), ("ipv4", "1.2.3.4"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000"), ("phone", "+5551234"), ("ssn", "123-45-6789"), ("secret", "-" * 15 + "a"), ("given-n", "anna")]:
        sizes = [len(pii.replaced(kind, canonical, n, b"k")) for n in (0, 200, 2000)]
        assert sizes[0] < sizes[1] < sizes[2], (kind, sizes)
    assert pii.luhn(pii.replaced("card", "4111111111111111", 30, b"k"))
