"""Operator 13: collocations of two and three words, counted by vertical partitioning of a depth-truncated suffix tree.

Every word that another follows in its piece starts a suffix, cut to three words. The tree of all suffixes is never built whole:

1. *Prefixes.* Word frequencies are counted over the whole corpus. Prefixes that are neighbours in key order are grouped until a group's suffixes
   reach the memory budget. A word that alone exceeds it is extended: its suffixes are counted by their second word and grouped again, and so
   for pairs by the third. Runs of prefixes are cut by running sums on the executors; only the groups' lower bounds reach the driver,
   about one for each budget's worth of suffixes.
2. *Subtrees.* Parts of the corpus sort their own suffixes, count equal ones and send each group its run, packed. Each group then builds its
   subtree alone, as sorted arrays: leaves are distinct suffixes with their totals, inner nodes sum their leaves. Nodes below the least count stay
   there, but for a group's first and last inner nodes, which the next group may share and which are summed afterwards.
3. *Scores.* Cuts, containment and ranks are joins and windows over the nodes that remain.

A key is the 64-bit fingerprint of a language and a word. Fingerprints are compared over the distinct words that the parts of the corpus report, and where two words share one everything
starts again with other fingerprints. (Two words of one fingerprint that never stand in different parts of 2 MB would go unseen.)

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``; null texts are empty and have no words, a null lang is ``und``.
Repeated rows count again. Ties in rank go by score, count, then the phrase's bytes. Long texts are worked on whole. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bytesvec import LOWER, SPACE, U64, Words, give_back, mix, packed, pieces, span_hashes
from .common import dropped, settled, shared_dir, table

#: Suffixes of a group at most, where their prefix can be extended; words of a phrase; least count of a candidate; phrases of a language.
BUDGET, LEAST, TOP = 2_000_000, 10, 2000
#: Text bytes worked on at once.
PART = 1 << 21
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PLAIN = LOWER.copy()
_PLAIN[_ENDS | SPACE] = 0x20
_COUNTED = "code long, lang string, word string, c long"
_RUN = "grp int, codes binary, a binary, b binary, c binary, n binary"
_NODES = "w1 long, w2 long, w3 long, c long"
_SALTS = 64


def coded(part: pa.RecordBatch, seed: int) -> tuple[Words, np.ndarray, np.ndarray, pa.Array]:
    """Words of the texts, the key of each (never 0), whether the next word follows it in the same piece, and the languages of the texts."""
    data, offs = packed(part["text"])
    words = Words(_PLAIN[data], offs)
    langs = pc.fill_null(part["lang"], "und")
    size = len(words.start)
    if not size:
        return words, np.zeros(0, U64), np.zeros(0, bool), langs
    name, at = packed(langs)
    by_text = np.zeros(len(langs), U64)
    full = at[1:] > at[:-1]
    by_text[full] = span_hashes(name, [(at[:-1][full], at[1:][full])])[0]
    swapped = ((np.arange(256) * (2 * seed + 1) + seed) & 255).astype(np.uint8)
    code = mix(span_hashes(swapped[words.data], [(words.start, words.end)])[0] ^ mix(by_text + U64(2 * seed + 1))[words.text])
    code[code == 0] = 1
    ended = np.cumsum(_ENDS[data])[words.start]
    follows = np.append((ended[1:] == ended[:-1]) & (words.text[1:] == words.text[:-1]), False)
    return words, code, follows, langs


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offs = np.append(0, np.cumsum(size))
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[at]))


def _suffixes(code: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The second and third word of each suffix of two words at least (0: none), and its start."""
    start = np.flatnonzero(follows)
    third = np.zeros(len(start), U64)
    more = follows[start + 1]
    third[more] = code[start[more] + 2]
    return code[start], code[start + 1], third, start


def _sorted_distinct(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples in order, as places in the sorted array of their keys, which comes first; and the sums of n."""
    codes, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    at = at.astype(U64)
    a, b, c = at[: len(a)], at[len(a) : 2 * len(a)], at[2 * len(a) :]
    if len(codes) < 1 << 21:
        key = (a << U64(42)) | (b << U64(21)) | c
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((c, b, a))
    a, b, c, n = a[order], b[order], c[order], n[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))[: len(a)]
    return codes, a[new], b[new], c[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(code, lang, word, f) of all words."""

    def count(batches):
        for batch in batches:
            for part in pieces(batch, most=PART):
                words, code, _, langs = coded(part, seed)
                if not len(code):
                    continue
                distinct, first, c = np.unique(code, return_index=True, return_counts=True)
                text = _strings(words.data, words.start[first], words.end[first])
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), langs.take(pa.array(words.text[first])), text, pa.array(c, pa.int64())], ["code", "lang", "word", "c"])

    return docs.mapInArrow(count, _COUNTED).groupBy("code", "lang", "word").agg(F.sum("c").alias("f"))


class Bounds:
    """Lower bounds of the groups, as triples of keys in order; the first is (0, 0, 0)."""

    def __init__(self, found: list[tuple[int, int, int]]):
        self.keys = np.array(sorted({(0, 0, 0), *found}), U64).reshape(-1, 3)

    def cut(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where each group begins in sorted triples, and their number at the end."""
        k = self.keys
        at = np.searchsorted(a, k[:, 0])
        for i in np.flatnonzero((k[:, 1] > 0) | (k[:, 2] > 0)):
            lo, hi = at[i], np.searchsorted(a, k[i, 0], side="right")
            x = lo + np.searchsorted(b[lo:hi], k[i, 1])
            y = lo + np.searchsorted(b[lo:hi], k[i, 1], side="right")
            at[i] = x + np.searchsorted(c[x:y], k[i, 2])
        return np.append(at, len(a))


def group_bounds(docs: DataFrame, counts: DataFrame, seed: int, total: int, budget: int) -> Bounds:
    """Groups of prefixes with about ``budget`` suffixes each, by counts over the whole corpus."""
    hot = np.sort(np.array([x["code"] for x in counts.where(F.col("f") > budget // 8).select("code").distinct().collect()], np.int64).view(U64))
    bins = 1 << max(10, min(20, (4 * total // budget).bit_length()))
    edge = np.unique(np.concatenate([np.arange(bins, dtype=U64) * U64((1 << 64) // bins), hot, hot + U64(1)]))
    found: list[tuple[int, int, int]] = []
    prefixes: list[tuple[int, ...]] = [()]
    for depth in (1, 2, 3):
        known = np.array(prefixes, U64).reshape(len(prefixes), -1)

        def segments(batches, depth=depth, known=known):
            for batch in batches:
                if depth == 1:
                    seg = np.searchsorted(edge, batch["code"].to_numpy(zero_copy_only=False).view(U64), side="right") - 1
                    p, n = np.zeros(len(seg), np.int64), batch["f"].to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(seg.astype(np.int64)), pa.array(n)], ["p", "seg", "c"])
                    continue
                for part in pieces(batch, most=PART):
                    _, code, follows, _ = coded(part, seed)
                    keys = _suffixes(code, follows)[:3]
                    for p, prefix in enumerate(known):
                        mine = np.logical_and.reduce([keys[i] == prefix[i] for i in range(depth - 1)])
                        seg, n = np.unique(np.searchsorted(edge, keys[depth - 1][mine], side="right") - 1, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seg), p)), pa.array(seg.astype(np.int64)), pa.array(n.astype(np.int64))], ["p", "seg", "c"])

        source = counts.select("code", "f") if depth == 1 else docs
        sums = source.mapInArrow(segments, "p long, seg long, c long").groupBy("p", "seg").agg(F.sum("c").alias("c"))
        w = W.Window.partitionBy("p").orderBy("seg")
        single = np.isin(edge, hot)
        is_single = F.col("seg").isin([int(i) for i in np.flatnonzero(single)]) if single.any() else F.lit(False)
        sums = sums.withColumn("big", (F.col("c") > budget) & is_single)
        sums = sums.withColumn("fill", F.floor(F.sum("c").over(w.rowsBetween(W.Window.unboundedPreceding, -1)) / budget))
        cuts = sums.withColumn("cut", F.col("big") | F.lag("big").over(w) | (F.col("fill") != F.lag("fill").over(w))).where("cut").select("p", "seg", "big").collect()
        opened = []
        for x in cuts:
            key = (*prefixes[x["p"]], int(edge[x["seg"]]))
            found.append((*key, *[0] * (3 - len(key))))
            if x["big"] and depth < 3:
                opened.append(key)
        prefixes = opened
        if not prefixes:
            break
    return Bounds(found)


def phrase_nodes(docs: DataFrame, bounds: Bounds, seed: int, least: int) -> DataFrame:
    """(w1, w2, w3 or null, c) of all pairs and triples of keys that occur at least so often."""

    def runs(batches):
        for batch in batches:
            for part in pieces(batch, most=PART):
                _, code, follows, _ = coded(part, seed)
                a, b, c, _ = _suffixes(code, follows)
                codes, a, b, c, n = _sorted_distinct(a, b, c, np.ones(len(a), np.int64))
                cut = bounds.cut(codes[a.astype(np.int64)], codes[b.astype(np.int64)], codes[c.astype(np.int64)])
                out: dict[str, list] = {k: [] for k in ("grp", "codes", "a", "b", "c", "n")}
                for g in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[g], cut[g + 1])
                    used, at = np.unique(np.concatenate([a[s], b[s], c[s]]), return_inverse=True)
                    small = np.uint16 if len(used) <= 1 << 16 else np.uint32
                    x, y, z = at.astype(small).reshape(3, -1)
                    out["grp"].append(g)
                    for k, v in (("codes", codes[used.astype(np.int64)]), ("a", x), ("b", y), ("c", z), ("n", n[s].astype(np.uint32))):
                        out[k].append(v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out["grp"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in ("codes", "a", "b", "c", "n")]], list(out))

    def subtree(runs_: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for x in runs_.to_batches():
            for codes, a, b, c, n in zip(*(x[k] for k in ("codes", "a", "b", "c", "n")), strict=True):
                codes = np.frombuffer(codes.as_buffer(), U64)
                small = np.uint16 if len(codes) <= 1 << 16 else np.uint32
                for out, v in zip(parts, (a, b, c), strict=False):
                    out.append(codes[np.frombuffer(v.as_buffer(), small)])
                parts[3].append(np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64))
        codes, a, b, c, n = _sorted_distinct(*(np.concatenate(p) for p in parts))
        a, b, c = (codes[v.astype(np.int64)] for v in (a, b, c))
        inner = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        total = np.add.reduceat(n, inner)
        show = total >= least
        show[[0, -1]] = True
        leaf = np.flatnonzero((n >= least) & (c > 0))
        inner, total = inner[show], total[show]
        w1, w2 = (np.concatenate([v[inner], v[leaf]]).view(np.int64) for v in (a, b))
        w3 = np.concatenate([np.zeros(len(inner), U64), c[leaf]]).view(np.int64)
        give_back()
        return pa.table({"w1": w1, "w2": w2, "w3": pa.array(w3, mask=w3 == 0), "c": np.concatenate([total, n[leaf]])})

    nodes = docs.mapInArrow(runs, _RUN).groupBy("grp").applyInArrow(subtree, _NODES)
    return nodes.groupBy("w1", "w2", "w3").agg(F.sum("c").alias("a")).where(F.col("a") >= least)


def _score(l: str, r: str) -> F.Column:
    a, l, r = (f"CAST({x} AS DECIMAL(18, 0))" for x in ("a", l, r))
    return F.expr(f"CAST(({a} * {a} * 1000000) DIV ({l} * {r}) AS LONG)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 50, budget: int = BUDGET) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score) of documents (text, lang): the first ``top`` phrases of each language."""
    spark, docs = docs.sparkSession, docs.select("text", "lang")
    paths = [shared_dir(spark) for _ in range(2)]
    seed = 0
    while True:
        counts = settled(word_counts(docs, seed), paths[0])
        if counts.groupBy("code").count().where("count > 1").isEmpty():
            break
        dropped(spark, paths[0])
        seed += 1
    total = counts.agg(F.sum("f")).first()[0] or 0
    bounds = group_bounds(docs, counts, seed, total, max(1, min(budget, total // 64)))
    nodes = settled(phrase_nodes(docs, bounds, seed, least), paths[1])
    words = counts.where(F.col("f") >= least)
    first, second, third = (words.select(F.col("code").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"), *["lang"] * (i == 1)) for i in (1, 2, 3))
    twos, threes = nodes.where("w3 IS NULL").drop("w3"), nodes.where("w3 IS NOT NULL")
    longer = threes.select("w1", "w2", "a").union(threes.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    pairs = twos.join(longer, ["w1", "w2"], "left").where(f"longer IS NULL OR CAST(longer AS DECIMAL(18, 0)) * 100 < CAST(a AS DECIMAL(18, 0)) * {share}")
    pairs = pairs.join(first, "w1").join(second, "w2").select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"))
    whole = threes.join(twos.select("w1", "w2", F.col("a").alias("l2")), ["w1", "w2"]).join(twos.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["w2", "w3"])
    whole = whole.join(first, "w1").join(second, "w2").join(third, "w3").withColumn("s1", _score("f1", "r1")).withColumn("s2", _score("l2", "f3"))
    by_first = F.col("s1") <= F.col("s2")
    triples = whole.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
        F.when(by_first, F.col("f1")).otherwise(F.col("l2")).alias("l"), F.when(by_first, F.col("r1")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = pairs.union(triples).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = best.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    out = settled(best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    dropped(spark, *paths)
    return out


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_OP13 = r"""
WITH split AS (
  SELECT doc, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k
  FROM (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)
),
words AS (SELECT doc, k, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
each AS (SELECT doc, k, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM words),
next AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM each WINDOW p AS (PARTITION BY doc, k ORDER BY i)
),
ones AS (SELECT lang, w1, count(*) AS f FROM next GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ones GROUP BY lang),
twos AS (SELECT lang, w1, w2, count(*) AS f FROM next WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
threes AS (SELECT lang, w1, w2, w3, count(*) AS f FROM next WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, w1 || ' ' || w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM twos t JOIN ones x USING (lang, w1) JOIN ones y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM threes h WHERE h.lang = t.lang AND h.w1 = t.w1 AND h.w2 = t.w2 AND 100 * h.f >= 50 * t.f)
    AND NOT EXISTS (SELECT 1 FROM threes h WHERE h.lang = t.lang AND h.w2 = t.w1 AND h.w3 = t.w2 AND 100 * h.f >= 50 * t.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM threes t JOIN ones x USING (lang, w1) JOIN twos y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM threes t JOIN twos x USING (lang, w1, w2) JOIN ones y ON y.lang = t.lang AND y.w1 = t.w3
),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
