"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from revverify.llm import jaccard, licenses, mixing, pieces, pii, quality, sharding, tokenfiles, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, copies long"


def shingle_set(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_texts(rnd, groups, size, words=120, most=14):
    out = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(most)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 8, 10)])
def test_jaccard_equals_brute_force(spark, n, num, den):
    rnd = random.Random(n)
    texts = near_texts(rnd, 3, 60) + [f"a b {i}" for i in range(5)] + [None, "", "  \t", "One", "one", "a b", "A  b", "word " * 3000, " ".join(f"r{rnd.randrange(40)}" for _ in range(60))]
    texts += [t for t in texts[:20]] + [" ".join(f"q{i}" for i in range(k)) for k in range(8, 40)]
    rows = list(enumerate(texts))
    members, links = jaccard.jaccard_join(spark.createDataFrame(rows, "id long, text string"), n, num, den)
    got = {r["id"]: (r["n"], r["component"]) for r in members.collect()}
    sets = [shingle_set(t, n) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = roots(range(len(sets)), pairs)
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(sets))}
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links.collect()} <= {(min(p), max(p)) for p in pairs}


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "z y x"), (7, "z y x"), (9, None)]
    members, _ = jaccard.jaccard_join(spark.createDataFrame(rows, "id long, text string"), 3, 9, 10)
    got = sorted(members.collect(), key=str)
    assert {(r["id"], r["component"]) for r in got} == {(None, None), (4, 4), (7, 4), (9, 9)} and len(got) == 6
    empty, _ = jaccard.jaccard_join(spark.createDataFrame([], "id long, text string"))
    assert empty.count() == 0
    docs = spark.createDataFrame([(1, "p q r s t u", "s", 5), (2, "P q r s t u", "s", 5), (3, "other text here", "s", 5)], DOC)
    assert [r["doc_id"] for r in jaccard.one_of_each_group(docs).orderBy("doc_id").collect()] == [1, 3]


def test_near_vectors_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base, base[:10].repeat(12, 0) + 0.12 * rng.standard_normal((120, 16)), base[:3].repeat(5, 0)])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, x[0].tolist(), None), (1006, x[0].tolist()[:5], 0)]
    members, _ = vectors.near_vectors(spark.createDataFrame(rows + odd, "id long, vec array<double>, label long"), block=16, recall=1 - 1e-9)
    got = {r["id"]: (r["n_links"], r["component"]) for r in members.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    comp = roots(range(len(x)), np.argwhere(near).tolist())
    want = {i: (int(near[i].sum()), comp[i]) for i in range(len(x))} | {i: (0, i) for i, _, _ in odd}
    assert got == want
    assert vectors.near_vectors(spark.createDataFrame([], "id long, vec array<double>, label long"))[0].count() == 0


def test_exact_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (300, 6))
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1] * 6), (900, None), (901, [None] * 6), (950, [1, 2])]
    got = vectors.exact_top_k(spark.createDataFrame(rows, "id long, vec array<long>"), "id % 25 = 0", k=5, point_block=64).collect()
    for q in range(0, 300, 25):
        s = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        assert sorted((r["rank"], r["id"], r["score"]) for r in got if r["query"] == q) == [(k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert vectors.exact_top_k(spark.createDataFrame([], "id long, vec array<long>"), "id % 50 = 0").count() == 0


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "The the THE, don't!", "x<|endoftext|>y", "é ÷ 日本 123", "long " * 20000, "a b", "a b"]
    rows = [(8 - i, t) for i, t in enumerate(texts)] + [(None, "last words")]
    tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), path)
    t = Tokenizer.from_file(path)
    want, start = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfiles.read_token_files(spark, str(tmp_path / "t"), digest=True).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    tokenfiles.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), path)
    assert tokenfiles.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_pack_numbers():
    x = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint64)
    assert (tokenfiles.unpack_numbers(*tokenfiles.pack_numbers(x), len(x)) == x).all()


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(5)
    texts = ["", None, " ", "  two  spaces", "▁mark", "日本語 😀", "a" * 3000, "x\n\n\ty", "".join(rnd.choice("theraion ,.é\n") for _ in range(6000))]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)]
    got = pieces.encode_pieces(spark.createDataFrame(rows, DOC), path).collect()
    assert [r["ids"] for r in sorted(got, key=lambda r: r["doc_id"])] == [sp.encode(t or "") for t in texts]
    assert all(r["round_trip"] for r in got)


def test_quality(spark):
    rnd = random.Random(6)
    good = [(i, " ".join(rnd.choice(["river", "stone", "house", "green"]) + "." for _ in range(40)), "s", 1) for i in range(200)]
    bad = [(i, " ".join(rnd.choice(["BUY!!", "CLICK$$$", "NOW!!"]) for _ in range(40)), "s", 1) for i in range(200, 300)]
    docs = spark.createDataFrame(good + bad + [(900, None, "s", 1), (901, "", "s", 1), (None, "x", "s", 1)], DOC)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)] + [(0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    out = docs.select("doc_id", quality.quality_score(model)(docs["text"]).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in out) and len(out) == 303
    assert all((r["s"] >= 0.3) == (r["doc_id"] < 200) for r in out if r["doc_id"] is not None and r["doc_id"] < 300)
    assert quality.good_documents(docs, labels).columns == docs.columns
    none = quality.fit_quality(docs, labels.limit(0))
    assert none.score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_sharding(spark):
    rnd = random.Random(7)
    rows = [(i, None if i % 50 == 0 else "é" * rnd.randrange(200), "s", 1) for i in range(3000)] + [(i, "copy " * 20, "s", 1) for i in range(3000, 4500)] + [(1, "again", "s", 1)] * 3
    out = sharding.histogram_shards(spark.createDataFrame(rows, DOC), 8).collect()
    sums = np.zeros(8)
    for s in range(8):
        mine = [r for r in out if r["shard"] == s]
        sums[s] = sum(r["size"] for r in mine)
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    assert abs(sums - sums.mean()).max() <= 0.01 * sums.mean() + 2 * 410
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert sharding.histogram_shards(spark.createDataFrame([], DOC), 8).count() == 0


def test_mixing(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rnd.randrange(30))) if i % 40 else None, rnd.choice(["a", "b", "ü", "Z", None, "hot", "hot", "hot"]), 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOC)
    out = mixing.mix(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    size = {s: sum(len(WORD.findall(t or "")) for _, t, x, _ in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            open_.remove(s)
    for s in order:
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 30
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 and len(r["shards"]) == r["copies"] for r in mine)
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in out) and mixing.mixed_documents(docs).columns == docs.columns


def test_pii(spark):
    texts = [
        "Mail ann.lee@corp.com or ANN.LEE@corp.com, phone +1 (415) 555-2671, IP 8.8.4.4.", "Card 4111 1111 1111 1111, not 4111 1111 1111 1112.",
        "Frau Anna Schmidt met Herr Schmidt; token = \"0123456789abcdef0123456789abcdef01234567\"", "Clean text with version 3 and 2024.", None, "", "ann.lee@corp.com " * 2000,
    ]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "8.8.4.4", "s", 1)], DOC)
    out = {r["doc_id"]: r for r in pii.pseudonymised(docs, pii.TEST_KEY).collect()}
    assert out[3]["text"] == texts[3] and out[4]["text"] is None and out[5]["text"] == ""
    a = re.findall(r"\S+@\S+com", out[0]["text"])
    assert a[0].lower() == a[1].lower() != "ann.lee@corp.com" and a[0] in out[6]["text"] and "ann.lee" not in out[6]["text"]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, IP", out[0]["text"]) and "8.8.4.4" not in out[0]["text"]
    assert out[None]["text"] in out[0]["text"]
    card = re.search(r"Card ((?:\d{4} ?){4})", out[1]["text"])[1]
    assert pii.luhn(card.replace(" ", "")) and card.strip() != "4111 1111 1111 1111" and "4111 1111 1111 1112" in out[1]["text"]
    m = re.match(r"Frau (\w+a) (\w+) met Herr (\w+);", out[2]["text"])
    assert m and m[2] == m[3] and "Schmidt" not in out[2]["text"]
    # Addresses of one digit each are few: distinct ones keep distinct surrogates.
    many = spark.createDataFrame([(i, f"{i // 1000}.{i // 100 % 10}.{i // 10 % 10}.{i % 10}", "s", 1) for i in range(1000, 1300)], DOC)
    new = [r["text"] for r in pii.pseudonymised(many, pii.TEST_KEY).collect()]
    old = {r["text"] for r in many.collect()}
    assert len(set(new)) == 300 and not old & set(new)


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "print(1)"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("z/x.py", "nothing"), (None, None), ("a/b/x.py", "print(1)"), ("q/LICENSE.txt", ""),
    ]
    out = {r["path"]: r for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert out["a/LICENSE"]["own"] == "MIT" and out["a/b/x.py"]["license"] == "MIT" and out["a/b/x.py"]["inherited_from"] == "a"
    assert out["a/b/c/y.py"]["license"] == "Apache-2.0" and out["z/x.py"]["license"] is None and out["q/LICENSE.txt"]["license"] is None
    assert licenses.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0
