"""Every query over a small folder of tables: columns, types, parameters and brute force; the pipeline stage by stage; components, trees and statistics told slowly."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from revverify.llm import common, queries, quality
from tests.llm.test_operators import WORD, near_texts, roots, shingle_set

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SOURCES = ["web", "web", "web", "ü", "books", None]


def texts_of(rnd):
    good = [" ".join(rnd.choice("river stone house green light valley under winter".split()) + f"{rnd.randrange(900)}" for _ in range(60)) + "." for _ in range(120)]
    bad = [" ".join(rnd.choice(["BUY!!", "CLICK$$$", "NOW!!", "WIN%%"]) + str(rnd.randrange(900)) for _ in range(60)) for _ in range(60)]
    near = near_texts(rnd, 2, 12, words=80, most=8)
    private = [f"Please write to person{i}@mail{i % 3}.example.org or call +1 (415) 555-26{10 + i} about the winter stones {i}." for i in range(10)]
    return good, bad, near + near[:6] + private + ["One", "a b", "long river " * 4000]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rnd, at = random.Random(11), tmp_path_factory.mktemp("tables")
    good, bad, more = texts_of(rnd)
    texts = good + bad + more
    rows = [(i, t, "en", rnd.choice(SOURCES), len(t)) for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "", "en", "web", 0), (None, good[0] + " late", "en", "web", 5), rows[3], rows[3]]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i < len(good)), 0) for i in range(len(good) + len(bad))] + [(None, 1, 0), (5, None, 0), (0, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rng = np.random.default_rng(2)
    x = rng.standard_normal((203, 8))
    x[100:110] = x[0] + 0.05 * rng.standard_normal((10, 8))
    vectors = [(i, v.astype(np.float32).tolist(), 1 if i % 2 == 0 else None) for i, v in enumerate(x)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (400, [None] * 8, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at), rows, labels, vectors


@pytest.fixture(scope="module")
def none_at_all(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("none")
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


TYPES = {
    "op1_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_piece_encoding": {"doc_id": "bigint"},
    "op3_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_histogram_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_pii_surrogates": {"doc_id": "bigint", "n_entities": "int", "text": "string"},
    "op8_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op9_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_license_scan": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", list(TYPES))
def test_columns_and_empty_tables(spark, none_at_all, name):
    df = queries.QUERIES[name](spark, none_at_all)
    assert TYPES[name].items() <= dict(df.dtypes).items()
    assert df.count() == 0


def test_op1_and_op8(spark, made):
    sf, _, _, vectors = made
    use = {i: np.array(v, np.float64) for i, v, _ in vectors if v and None not in v and np.isfinite(v).all()}
    label = {i: x for i, _, x in vectors}
    on = [i for i in use if label[i] is not None and use[i].any()]
    links = [(a, b) for a in on for b in on if a < b and label[a] == label[b] and use[a] @ use[b] / math.sqrt(use[a] @ use[a]) / math.sqrt(use[b] @ use[b]) >= 0.93]
    comp = roots([i for i, _, _ in vectors], links)
    got = queries.QUERIES["op1_embedding_near_dedup"](spark, sf).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted((i, sum(i in p for p in links), comp[i], comp[i] == i) for i in comp)
    assert len(links) >= 10
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in use.items()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = queries.QUERIES["op8_exact_top_k"](spark, sf).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_op3(spark, made):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sf, rows, _, _ = made
    got = sorted(queries.QUERIES["op3_token_files"](spark, sf).collect(), key=lambda r: r["start"])
    want = [(d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x, *_ in rows]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want), key=str)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)


def test_op4_learns_from_the_right_rows(spark, made):
    sf, rows, labels, _ = made
    got = queries.QUERIES["op4_quality_classifier"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    truth = {d: q for d, q, _ in labels if q is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    # Labels of the held-out fifth do not reach the model.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    turned = [(d, 1 - q if q is not None and d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q, _ in labels]
    a = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    b = quality.fit_quality(docs, spark.createDataFrame(turned, "doc_id long, quality int"))
    assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "threshold", "left", "right", "value", "roots"))


def test_op5(spark, made):
    sf, rows, _, _ = made
    sets = {d: shingle_set(t, 3) for d, t, *_ in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    comp = roots(ids, links)
    got = queries.QUERIES["op5_ngram_jaccard_join"](spark, sf).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, len(sets[i]), comp[i]) for i in ids}
    assert len(got) == len(rows)


def test_op6_and_op9(spark, made):
    sf, rows, _, _ = made
    got = queries.QUERIES["op6_histogram_sharding"](spark, sf).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=str)
    assert all(0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    for s in range(24):
        mine = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))
    got = queries.QUERIES["op9_source_mixing"](spark, sf).collect()
    words = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((d, w) for (d, *_), w in zip(rows, words, strict=True)), key=str)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    total = {s: sum(w for r, w in zip(rows, words, strict=True) if r[3] == s) for s in SOURCES}
    for s in set(SOURCES):
        assert any(r["source_size"] == total[s] for r in got)
    assert abs(sum({r["source_size"]: r["target"] for r in got}.values()) - 1.5 * sum(words)) < 1e-3


def test_pipeline_stages_against_brute_force(spark, made):
    import sentencepiece

    sf, rows, labels, _ = made
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = common.shared_dir(spark)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    assert [x.columns for x in out[:-1]] == [docs.columns] * 5
    before, good, single, clean, mixed, ids = ([tuple(r) for r in x.collect()] for x in out)
    # Quality: each text walked through the trees alone.
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(good, key=str) == sorted((r for r in before if walked(model, r[1]) >= 0.3), key=str)
    n_good = sum(q == 1 for _, q, _ in labels[:120])
    assert {d for d in range(n_good)} <= {r[0] for r in good} and not {d for d in range(120, 180)} & {r[0] for r in good}
    # One of each group.
    sets = {r[0]: shingle_set(r[1], 5) for r in good if r[0] is not None}
    keys = sorted(sets)
    comp = roots(keys, [(a, b) for a in keys for b in keys if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    assert sorted(single, key=str) == sorted((r for r in good if r[0] is None or comp[r[0]] == r[0]), key=str)
    assert len(single) < len(good)
    # Personal data go, texts without any stay as they are.
    assert len(clean) == len(single) and not any("@mail" in (r[1] or "") and "person" in r[1] for r in clean)
    same = lambda x: sorted((r for r in x if "Please write" not in (r[1] or "")), key=str)
    assert [r[:4] for r in same(clean)] == [r[:4] for r in same(single)]
    assert all(r[4] == len(r[1]) for r in clean if r[1] is not None)
    # The mix: only rows that came in, none above twice as often, each source near its target.
    size = lambda r: len(WORD.findall(r[1] or ""))
    assert set(mixed) <= set(clean) and all(mixed.count(r) <= 2 * clean.count(r) for r in set(mixed))
    words = sum(map(size, clean))
    assert abs(sum(map(size, mixed)) - 1.5 * words) <= max(map(size, clean)) * len(set(SOURCES))
    # Ids of every copy.
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    place = out[-1].columns.index("ids")
    assert sorted((r[0] or -1, list(r[place])) for r in ids) == sorted((r[0] or -1, sp.encode(r[1] or "")) for r in mixed)
    # run() is these stages and nothing else.
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, out[-1].collect()))


def test_pipeline_of_empty_tables(spark, none_at_all):
    assert corpus_pipeline.run(spark, none_at_all).count() == 0


def walked(model, text):
    x, raw = quality.statistics(pa.array([text], pa.string()))[0], model.base
    for i in model.roots:
        while model.left[i] != i:
            i = model.left[i] if x[model.feature[i]] <= model.threshold[i] else model.right[i]
        raw += model.value[i]
    return 1 / (1 + math.exp(-raw))


def test_statistics_told_slowly():
    texts = ["Two words.\nTwo words.\n\nlast line 7", "", None, "ÄÖ ünder", "AAA bbb AAA", " \n ", "x" * 500]
    got = quality.statistics(pa.array(texts, pa.string()))
    at = {n: i for i, n in enumerate(quality.FEATURES)}
    for row, t in zip(got, texts, strict=True):
        raw, words = (t or "").encode(), WORD.findall(t or "")
        share = lambda n, of: n / of if of else 0.0
        lines = [x for x in raw.split(b"\n") if x]
        want = {
            "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(words)), "upper": share(sum(65 <= b <= 90 for b in raw), len(raw)), "digit": share(sum(48 <= b <= 57 for b in raw), len(raw)),
            "high": share(sum(b >= 128 for b in raw), len(raw)), "distinct_words": share(len(set(words)), len(words)), "short_words": share(sum(len(w.encode()) <= 2 for w in words), len(words)),
            "top_word": share(max((words.count(w) for w in words), default=0), len(words)), "log_lines": math.log1p(len(lines)), "line_length": share(sum(map(len, lines)), len(lines)),
            "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1) if raw else 0.0, "entropy": -sum(p * math.log2(p) for p in (raw.count(bytes([b])) / len(raw) for b in set(raw))),
        }
        assert {k: row[at[k]] for k in want} == pytest.approx(want), t


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 4))
    y = (x[:, 2] + 0.3 * rng.standard_normal(300) > 0.2).astype(float)
    model = quality.fit_trees(x, y, trees=1, depth=1, rate=1.0, least=5)
    p = 1 / (1 + math.exp(-model.base))
    g, h = p - y, p * (1 - p)
    gain = lambda m: g[m].sum() ** 2 / (h * m.sum() + 1) + g[~m].sum() ** 2 / (h * (~m).sum() + 1)
    best = max(gain(x[:, j] <= e) for j in range(4) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) if 5 <= (x[:, j] <= e).sum() <= 295)
    root = model.roots[0]
    m = x[:, model.feature[root]] <= model.threshold[root]
    assert model.feature[root] == 2 and gain(m) == pytest.approx(best)
    assert model.value[model.left[root]] == pytest.approx(-g[m].sum() / (h * m.sum() + 1)) and model.value[model.right[root]] == pytest.approx(-g[~m].sum() / (h * (~m).sum() + 1))


def test_components_of_a_chain_and_a_star(spark):
    rnd = random.Random(9)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5, i) for i in range(2000, 5000)]
    edges = chain + star + [(7, 7), (None, 3), (3, None), (1, 2), (2, 1), (1, 2)]
    rnd.shuffle(edges)
    got = common.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    want = {i: 1000 for i in range(1000, 1401)} | {i: 5 for i in [5, *range(2000, 5000)]} | {1: 1, 2: 1}
    assert {r["id"]: r["root"] for r in got} == want and len(got) == len(want)
