"""Operator 4: document quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesvec import SPACE, Words, first_seen, mix, packed, per_text, pieces, span_hashes
from .common import small_side, table

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_PUNCT = (_BYTE > 32) & ~_LETTER & ~_DIGIT
_MARKS = np.isin(_BYTE, [ord(c) for c in ".,;:'\"-?()"])
_VOWEL = np.isin(_BYTE, [ord(c) for c in "aeiouyAEIOUY"])

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "punct", "odd_punct", "space", "high", "vowel", "entropy", "word_length", "short_words", "long_words",
    "distinct_words", "top_word", "upper_words", "punct_end", "odd_end", "double_end", "digit_words", "mixed_words", "log_lines", "line_length", "repeated_lines",
    "repeated_line_words", "repeated_pairs", "ends_marked",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES of whole texts, one row each. Only the text speaks; an empty or null text has zeros."""
    data, offs = packed(texts)
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
    hist = np.bincount(np.repeat(np.arange(n), np.diff(offs)) * 256 + data, minlength=n * 256).reshape(n, 256)
    words = Words(data, offs)
    count, owner, length = words.count.astype(float), words.text, words.end - words.start
    per = lambda x: np.bincount(owner, x, n)
    newline = np.flatnonzero(data == 10)
    # Lines: from each text's start and after each line break to the next break or the text's end.
    begin = np.union1d(offs[:-1][size > 0], newline + 1)
    begin = begin[begin < len(data)]
    stop = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    stop = stop - (data[np.maximum(stop - 1, 0)] == 10) if len(begin) else stop
    solid = stop > begin
    begin, stop = begin[solid], stop[solid]
    line_of = np.searchsorted(offs, begin, side="right") - 1
    w, line = span_hashes(data, [(words.start, words.end), (begin, stop)])
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))

    def repeats(keys: np.ndarray, whose: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: weight of the distinct keys, and the largest count of one key."""
        code, first = first_seen(keys ^ salt[whose])
        top = np.zeros(n)
        if len(code):
            np.maximum.at(top, whose[first], np.bincount(code))
        return np.bincount(whose[first], weight[first], n), top

    distinct, top = repeats(w, owner, np.ones(len(w)))
    lines = np.bincount(line_of, minlength=n).astype(float)
    line_bytes = np.bincount(line_of, stop - begin, n)
    kept_lines, _ = repeats(line, line_of, np.ones(len(line)))
    kept_bytes, _ = repeats(line, line_of, (stop - begin).astype(float))
    same = owner[1:] == owner[:-1]
    pair = mix(w[:-1][same] * np.uint64(3) + w[1:][same])
    pairs = np.bincount(owner[1:][same], minlength=n).astype(float)
    kept_pairs, _ = repeats(pair, owner[1:][same], np.ones(len(pair)))
    last = data[np.maximum(words.end - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    before = data[np.maximum(words.end - 2, 0)] if len(data) else last
    head = data[words.start] if len(data) else last
    digits, uppers, puncts = (np.concatenate([[0], np.cumsum(m[data])]) for m in (_DIGIT, _UPPER, _PUNCT))
    within = lambda c: c[words.end] - c[words.start]
    has_digit, all_upper = within(digits) > 0, (within(uppers) >= 2) & (within(uppers) + within(puncts) == length)
    prob = hist / np.maximum(size, 1)[:, None]
    entropy = -(prob * np.log2(np.where(prob > 0, prob, 1))).sum(axis=1)
    total = lambda mask: hist @ mask.astype(float)
    line_end = data[np.maximum(stop - 1, 0)] if len(begin) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(size), np.log1p(count), share(total(_UPPER), size), share(total(_DIGIT), size), share(total(_PUNCT), size), share(total(_PUNCT & ~_MARKS), size),
        share(total(SPACE), size), share(total(_BYTE >= 128), size), share(total(_VOWEL), total(_LETTER)), entropy, share(per(length), count),
        share(per(length <= 2), count), share(per(length > 12), count), share(distinct, count), share(top, count), share(per(all_upper), count),
        share(per(_PUNCT[last]), count), share(per(_PUNCT[last] & ~_MARKS[last]), count), share(per(_PUNCT[last] & (last == before) & (length > 1)), count),
        share(per(has_digit), count), share(per(~_UPPER[head] & (within(uppers) > 0)), count), np.log1p(lines), share(line_bytes, lines), 1 - share(kept_lines, np.maximum(lines, 1)),
        1 - share(kept_bytes, np.maximum(line_bytes, 1)), 1 - share(kept_pairs, np.maximum(pairs, 1)), share(np.bincount(line_of, _MARKS[line_end], n), lines),
    ]
    out = np.column_stack(columns)
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """All nodes of all trees in flat arrays. Node i sends a row left when x[feature[i]] <= threshold[i]; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            raw += self.value[at]
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Gradient boosting with logistic loss on features cut into at most ``bins`` quantile bins."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if n else np.zeros((0, k), int)
    mean = min(max((y.sum() + 0.5) / (n + 1), 1e-4), 1 - 1e-4) if n else 0.5
    out: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    roots, raw = [], np.full(n, np.log(mean / (1 - mean)))

    def node(value: float) -> int:
        i = len(out["value"])
        for c, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            out[c].append(v)
        return i

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        root = node(0.0)
        roots.append(root)
        place = np.full(n, root)
        level = [root]
        for _ in range(depth):
            index = np.full(len(out["value"]), -1)
            index[level] = np.arange(len(level))
            at = index[place]
            live = np.flatnonzero(at >= 0)
            size = len(level) * bins
            best = [(1e-6, None)] * len(level)
            for j in range(k):
                key = at[live] * bins + binned[live, j]
                sums = [np.cumsum(np.bincount(key, v, size).reshape(-1, bins), axis=1) for v in (g[live], h[live], np.ones(len(live)))]
                (gl, hl, cl), (ga, ha, ca) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(cl < least) | (ca - cl < least)] = -1
                cut = gain[:, : max(1, len(edges[j]))].argmax(axis=1)
                for q in range(len(level)):
                    if len(edges[j]) and gain[q, cut[q]] > best[q][0]:
                        best[q] = (gain[q, cut[q]], (j, int(cut[q])))
            after = []
            for q, i in enumerate(level):
                if best[q][1] is None:
                    continue
                j, cut = best[q][1]
                out["feature"][i], out["threshold"][i] = j, edges[j][cut]
                out["left"][i], out["right"][i] = node(0.0), node(0.0)
                rows = np.flatnonzero(place == i)
                place[rows] = np.where(binned[rows, j] <= cut, out["left"][i], out["right"][i])
                after += [out["left"][i], out["right"][i]]
            level = after
            if not level:
                break
        sums = [np.bincount(place, v, len(out["value"])) for v in (g, h)]
        for i in np.unique(place):
            out["value"][i] = rate * sums[0][i] / (sums[1][i] + l2)
        raw += np.array(out["value"])[place]
    arrays = {c: np.array(v, float if c in ("threshold", "value") else np.int64) for c, v in out.items()}
    return Trees(**arrays, roots=np.array(roots, np.int64), depth=depth, base=float(np.log(mean / (1 - mean))))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **how) -> Trees:
    """Fit on documents (doc_id, text) with labels (doc_id, quality), never on those held out.

    At most ``sample`` labelled doc_ids, chosen by hash, are used: their statistics are all that reaches the driver. A doc_id with
    several labels counts by their mean (0.5 and up: 1); null labels are left out. Without labels of both kinds every score
    is the share of ones (0.5 without any).
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(small_side(chosen, sample), "id")

    def run(batches):
        for batch in batches:
            for x in pieces(batch):
                yield pa.record_batch([x["id"], x["y"], pa.array(list(statistics(x["text"])), pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = sorted(((r["id"], r["y"], r["x"]) for r in rows.mapInArrow(run, "id long, y int, x array<double>").collect()))
    return fit_trees(np.array([r[2] for r in got], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], float), **how)


def quality_score(model: Trees):
    """A function of a text column: the model's score of each whole text, the score of an empty text for null."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], names=["text"])
        got = [model.score(statistics(x["text"])) for x in pieces(batch)]
        return pa.array(np.concatenate(got) if got else np.zeros(0))

    return lambda text: score(text.cast("string"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score from a model that never saw the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality_score(model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    score = quality_score(fit_quality(docs, labels))
    return docs.withColumn("score_of_quality", score(F.col("text"))).where(F.col("score_of_quality") >= least).select(docs.columns)
