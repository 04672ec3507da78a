"""Conversation repair, substring dedup and phrase mining through their queries against slow versions, on odd rows, empty tables and extra columns."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from revverify.llm import conversations, phrases, queries, repeats

CONVERSATIONS, DOCUMENTS = "conv_id long, turn long, role string, text string", "doc_id long, text string, lang string"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def scripts_told_slowly(rows):
    """Every conversation's facts and its cheapest, then least, script by trying all edits."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs[c] += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    out = []
    for c, v in convs.items():
        v.sort(key=lambda a: (a[0] is not None, a[0] or 0, a[1].encode(), a[2].encode()))
        seen, fault = set(), []
        for _, r, x in v:
            s = re.sub(r"[\x20\x09-\x0D]", "", x)
            fault.append("blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else "")
            seen.add((r, x))

        @cache
        def go(p, q, inserted, v=v, fault=fault):
            best = [(0, "", ())] if p == len(v) and q in ("", "a") else []
            name = "assistant" if q == "u" else "user"

            def add(cost, letter, line, to):
                if to is not None:
                    best.append((cost + to[0], letter + to[1], line + to[2]))

            if inserted < 3:
                add(2, "I", (name + ":",), go(p, name[0], inserted + 1))
            if p < len(v):
                add(3, "D", (), go(p + 1, q, 0))
                if fault[p] not in ("blank", "duplicate"):
                    _, role, text = v[p]
                    more = fault[p] == "truncated"
                    if (q, role[:1]) in step:
                        add(more, "K", (f"{role}:{text}",), go(p + 1, step[q, role[:1]], 0))
                    add(2 + more, "R", (f"{name}:{text}",), go(p + 1, name[0], 0))
            return min(best) if best else None

        cost, audit, lines = go(0, "", 0)
        turns = [t for t, _, _ in v if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False))
        out.append((c, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return ordered(out)


def talk(rnd):
    rows = []
    for c in [None, *range(40)]:
        for t in range(300 if c == 7 else rnd.choice([1, 2, 3, 5, 9, 20])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"])
            rows.append((c, rnd.choice([t, t, t, 2 * t, None]), role, rnd.choice(["a b.", "x", "hi there!", "what?", " \t", "", None, "ü.", "ok. \n", f"{t}.", f"{t}?"])))
    return rows + rows[:3]


def test_op11(spark, tmp_path):
    """One conversation is longer than a block."""
    sys.setrecursionlimit(max(20_000, sys.getrecursionlimit()))
    rows = talk(random.Random(8))
    clash = spark.createDataFrame([(*r, "own", 5) for r in rows], CONVERSATIONS + ", root string, g int")
    clash.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert ordered(map(tuple, got.collect())) == scripts_told_slowly(rows)


def test_op11_paths_of_any_graph(spark):
    """Pointers over 1, 2, 4, ... letters along least paths, past the ends of short ones, and ranks that order all audits."""
    arcs = [(1, 2, "b"), (1, 3, "a"), (2, 4, "b"), (3, 4, "c"), (3, 2, "b"), (4, None, "c"), (5, 6, "a"), (6, 7, "b"), (7, 8, "b"), (8, None, "a")]
    df = spark.createDataFrame([(s, d, ord(x), 3) for s, d, x in arcs], "src long, dst long, letter int, need int")
    letters, pointers, _ = conversations.ranked_paths(df)
    starts = spark.createDataFrame([(1, 1), (5, 5)], "root long, node long")
    nodes = conversations.followed(starts, pointers).join(letters.withColumnRenamed("src", "node"), "node").orderBy("root", "at").collect()
    assert [(r["root"], r["node"], chr(r["letter"])) for r in nodes] == [(1, 1, "a"), (1, 3, "b"), (1, 2, "b"), (1, 4, "c"), (5, 5, "a"), (5, 6, "b"), (5, 7, "b"), (5, 8, "a")]


def kept_told_slowly(rows, width=13):
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - width + 1 if d is not None else 0):
            key = tuple(w[i : i + width])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        stay = [True] * len(w)
        for i in range(len(w) - width + 1 if d is not None else 0):
            if least[tuple(w[i : i + width])] < d:
                stay[i : i + width] = [False] * width
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return ordered(out)


def texts(rnd, words):
    vocab = [f"w{i}" for i in range(words)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([0, 5, 12, 13, 14, 40, 200]))] for _ in range(25)]
    rows = []
    for i in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        w = w[: rnd.randrange(len(w) + 1)] + rnd.choice(base) + w if rnd.random() < 0.3 else w
        w = ["a"] * rnd.randrange(40) + w if rnd.random() < 0.1 else w
        rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice([" ", "\n", " \t"]).join(w) if rnd.random() < 0.95 else None, "en"))
    return rows + [(500, "long river " * 3000, "en"), (501, "ü river " * 30, "en"), (502, "", "en")] + rows[:2]


@pytest.mark.parametrize("words", [3, 60])
def test_op12(spark, tmp_path, words):
    rows = texts(random.Random(words), words)
    clash = spark.createDataFrame([(*r, 1, "own") for r in rows], DOCUMENTS + ", chunk int, kept string")
    clash.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_substring_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = kept_told_slowly(rows)
    assert ordered(map(tuple, got.collect())) == want
    assert sum(r[2] for r in want) > 500


def test_op12_texts_and_other_widths(spark):
    rows = texts(random.Random(5), 9)
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = repeats.without_repeats(df, width=6, most=1, texts=True).collect()
    assert ordered((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == kept_told_slowly(rows, 6)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_op12_interior_symbols():
    """Equal word sequences have the same symbols wherever the context lies inside them."""
    rng = np.random.default_rng(3)
    inner = rng.integers(0, 5, 60).astype(np.uint64)
    found = []
    for _ in range(4):
        left, right = (rng.integers(0, 5, int(rng.integers(0, 20))).astype(np.uint64) for _ in range(2))
        names = repeats.mix(np.concatenate([left, inner, right]) + np.uint64(1))
        at, n = len(left), len(names)
        levels = repeats.rounds(names, np.zeros(n, np.int64), np.array([0, n]), 3)
        inside = [(low >= at) & (high <= at + 60) for _, low, high in levels]
        found.append([[(int(x), int(a) - at, int(b) - at) for x, a, b in zip(names[i], low[i], high[i], strict=True) if 15 <= a - at and b - at <= 45] for (names, low, high), i in zip(levels, inside, strict=True)])
    assert all(f == found[0] for f in found) and all(found[0])


def phrases_told_slowly(rows, least=10, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in some.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in some.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def spoken(rnd, words):
    vocab = [f"w{i}" for i in range(words)] + ["Ü", "The", "of"]
    rows = []
    for i in range(120):
        w = [rnd.choice(vocab[:3] if rnd.random() < 0.4 else vocab) + rnd.choice(["", "", "", "", " ", ".", ",", "\n", "\t"]) for _ in range(rnd.choice([0, 1, 2, 30, 200]))]
        rows.append((i, " ".join(w) if rnd.random() < 0.97 else None, rnd.choice(["en", "en", "de", None, "und", ""])))
    return rows + rows[:5]


def test_op13(spark, tmp_path):
    rows = spoken(random.Random(1), 16)
    clash = spark.createDataFrame([(*r, "own", 1) for r in rows], DOCUMENTS + ", word string, code int")
    clash.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_phrase_mining"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == phrases_told_slowly(rows)


def test_op13_small_groups(spark, monkeypatch):
    """Prefixes of every depth are split when a group may hold only few suffixes; parts of the corpus are small too."""
    monkeypatch.setattr(phrases, "PART", 1000)
    rows = spoken(random.Random(2), 5)
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    counts = phrases.word_counts(df, 0)
    bounds = phrases.group_bounds(df, counts, 0, 5000, 40)
    assert {int((k > 0).sum()) for k in bounds.keys} == {0, 1, 2, 3}
    assert sorted(map(tuple, phrases.collocations(df, budget=40, top=20).collect())) == phrases_told_slowly(rows, top=20)


def test_op13_wide_products(spark):
    """Counts whose products pass 64 bits."""
    a = 3_000_000_000
    df = spark.createDataFrame([(a, a + 1, a + 7)], "a long, f1 long, f2 long")
    assert df.select(phrases._score("f1", "f2")).first()[0] == 1_000_000 * a * a // ((a + 1) * (a + 7))


@pytest.mark.parametrize(("name", "table_", "schema"), [("op11_conversation_repair", "conversations", CONVERSATIONS), ("op12_substring_dedup", "documents", DOCUMENTS), ("op13_phrase_mining", "documents", DOCUMENTS)])
def test_empty_tables(spark, tmp_path, name, table_, schema):
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table_}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
