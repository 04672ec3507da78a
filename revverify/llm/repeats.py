"""Operator 12: words of repeated passages removed, found by recompression.

A text's words are compressed in rounds. A round first names each maximal *run* of equal symbols, then each *pair* of a
left and a right symbol; a symbol's side in a round is one bit of its name's hash. A name is a 64-bit fingerprint of what it stands for, so
equal runs and pairs get the same name in every text of the corpus without an exchange. Equal word sequences
get equal symbols except near their ends; how near is kept for each symbol as its *context*: the words that decide it, that is
its own span and those of the neighbours that were looked at. A symbol whose context lies inside a window is one of its interior symbols, and every
occurrence of that window, in any text, has it at the same place.

1. *Reveal.* Each window (``width`` consecutive words) takes one of its interior symbols of the highest round that left it any, the one
   with the least hash, together with its context's words. Neighbouring windows that took the same symbol make an *entry*: the symbol, and a fingerprint of all words that
   its windows cover. Entries meet by symbol. Only symbols met in two documents can belong to a repeat.
2. *Verify.* Equal entries (symbol and all words) settle all their windows at once: inside a long repeat, cores, contexts and therefore
   entries are equal. Where one symbol has several entries, the end of a repeat is near: the first holder of each such entry sends its windows, and these meet by a
   128-bit fingerprint of their words' names.
3. *Remove.* A word goes when a window that covers it also starts in a document with a smaller doc_id.

Work moves in chunks of whole documents, dealt by hash. A chunk sends an entry or a window once, with the smallest doc_id that holds it
there, packed for each bucket of symbols; what returns is one byte for each, in the order sent: does a smaller doc_id hold it elsewhere,
and are its windows wanted. So a passage that a third of all documents hold is one entry a chunk, texts and pairs never meet, and nothing grows with the square of a group.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have none. Empty texts, texts of fewer than ``width`` words and rows without a doc_id keep all words; a row without a doc_id removes
nothing from others. Repeated rows of one doc_id do not remove each other's words, as none is smaller. Long texts are worked on whole. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesvec import U64, Words, give_back, mix, packed
from .common import dropped, settled, shared_dir, table

#: Words of a window.
WIDTH = 13
#: Rounds of recompression; after more, few windows of 13 words have interior symbols left.
ROUNDS = 2
#: Text bytes of a chunk and of a bucket, about.
CHUNK, BUCKET = 1 << 20, 1 << 23
_SENT = "bucket int, chunk long, keys binary, ids binary"
_REPLY = "chunk long, bucket int, bits binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _odd(k: int) -> np.uint64:
    return mix(np.array([k], U64) * U64(0xA24BAED4963EE407))[0] | U64(1)


def rounds(names: np.ndarray, text: np.ndarray, bounds: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of the words and after each round: names, and first and last + 1 word of their contexts; one word beyond the text where a context passes its end. bounds: first words of the texts, and the number of words."""
    at = np.arange(len(names), dtype=np.int64)
    low, high = at, at + 1
    out = [(names, low, high)]
    for r in range(most):
        n = len(names)
        if not n:
            break
        # Runs.
        same = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
        first = np.flatnonzero(np.append(True, ~same))
        last = np.append(first[1:], n) - 1
        size = (last - first + 1).astype(U64)
        before = np.where((first > 0) & (text[first] == text[np.maximum(first - 1, 0)]), low[np.maximum(first - 1, 0)], bounds[text[first]] - 1)
        after = np.where((last < n - 1) & (text[last] == text[np.minimum(last + 1, n - 1)]), high[np.minimum(last + 1, n - 1)], bounds[text[last] + 1] + 1)
        names = np.where(size > U64(1), mix(names[first] * _odd(2) + mix(size * _odd(4 * r + 3))), names[first])
        text, low, high, n = text[first], before, after, len(first)
        # Pairs.
        right = (mix(names ^ _odd(1000 + r)) >> U64(63)).astype(bool)
        near = np.append(text[1:] == text[:-1], False)
        head = near & ~right & np.append(right[1:], False)
        tail = np.append(False, head[:-1])
        following = np.minimum(np.arange(n) + 1, n - 1)
        high = np.where(head, high[following], np.where(~right & ~tail, np.where(near, high[following], bounds[text + 1] + 1), high))
        prior = np.append(False, near[:-1])
        low = np.where(right & ~tail, np.where(prior, np.append(0, low[:-1]), bounds[text] - 1), low)
        names = np.where(head, mix(mix(names + _odd(4 * r + 5)) * _odd(4 * r + 6) + names[following]), names)
        keep = ~tail
        names, text, low, high = names[keep], text[keep], low[keep], high[keep]
        out.append((names, low, high))
    return out


class Entries:
    """The entries of a chunk of texts. For each: sym, key (of all words its windows cover), row (of the text), a and b (first and last + 1 window)."""

    def __init__(self, texts: pa.Array, width: int, most: int):
        words = Words(*packed(texts))
        self.width, self.count, self.first = width, words.count, words.first
        h = words.hashes() if len(words.start) else np.zeros(0, U64)
        n = len(h)
        self.sums = []
        for k in (7, 8):
            base = _odd(k)
            back = U64(pow(int(base), -1, 1 << 64))
            self.sums.append((np.append(U64(0), np.cumsum(mix(h ^ base) * _powers(base, n), dtype=U64)), _powers(back, n + 1)))
        starts = np.arange(n)
        whole = starts + width <= self.first[words.text + 1] if n else np.zeros(0, bool)
        level = np.full(n, -1, np.int64)
        chosen = np.zeros(n, np.int64)
        symbol = np.zeros(n, U64)
        for r, (names, low, high) in reversed(list(enumerate(rounds(h, words.text, words.first, most)))):
            open_ = np.flatnonzero(whole & (level < 0))
            if not len(open_):
                break
            lo = np.searchsorted(low, open_, side="left")
            hi = np.searchsorted(high, open_ + width, side="right")
            some = hi > lo
            open_, lo, hi = open_[some], lo[some], hi[some]
            inside = (low >= 0) & (high <= n)
            names = mix(names + self.words(0, np.where(inside, low, 0), np.where(inside, high, 0)))  # a symbol with the words that decide it
            order = mix(names ^ _odd(9))
            best = lo.copy()
            for t in range(1, int((hi - lo).max(initial=1))):
                at = lo + t
                at = np.where(at < hi, at, best)
                best = np.where(order[at] < order[best], at, best)
            level[open_], chosen[open_], symbol[open_] = r, best, names[best]
        at = np.flatnonzero(whole)
        new = np.append(True, (np.diff(at) != 1) | (level[at][1:] != level[at][:-1]) | (chosen[at][1:] != chosen[at][:-1]) | (words.text[at][1:] != words.text[at][:-1]))[: len(at)]
        self.a = at[new]
        self.b = np.append(self.a[1:], 0)
        if len(at):
            ends = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            self.b = ends + 1
        self.row = words.text[self.a] if n else np.zeros(0, np.int64)
        self.sym = symbol[self.a]
        self.key = mix(self.words(0, self.a, self.b + width - 1) + (self.b - self.a).astype(U64))

    def words(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of the words from a to b."""
        total, back = self.sums[which]
        return mix((total[b] - total[a]) * back[a])

    def windows(self, pick: np.ndarray) -> np.ndarray:
        """First words of all windows of the picked entries."""
        a, size = self.a[pick], (self.b - self.a)[pick]
        return np.repeat(a - np.append(0, np.cumsum(size)[:-1])[: len(size)], size) + np.arange(size.sum())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(max(n, 1), base, U64)
    x[0] = 1
    return np.cumprod(x, dtype=U64)[:n]


def _planes(ids: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on, which shuffle files compress well."""
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


class Sending:
    """Distinct keys (two arrays) of a chunk with the smallest id of each, in buckets; replies come back in the same order."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, buckets: int):
        self.order = np.lexsort((ids, y, x))
        x, y = x[self.order], y[self.order]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
        self.at = np.cumsum(new) - 1
        self.x, self.y, self.low = x[new], y[new], ids[self.order][new]
        part = (self.x >> U64(32)) * U64(buckets) >> U64(32)
        self.cut = np.searchsorted(part, np.arange(buckets + 1).astype(U64))

    def rows(self, chunk: int) -> pa.Table:
        full = np.flatnonzero(np.diff(self.cut))
        keys, ids = [], []
        for k in full:
            s = slice(self.cut[k], self.cut[k + 1])
            keys.append(np.stack([self.x[s], self.y[s]]).tobytes())
            ids.append(_planes(self.low[s]))
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "keys": pa.array(keys, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def replies(self, reply: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For each key as it was given: the byte that came back, and the smallest id that this chunk sent with it."""
        bits = np.zeros(len(self.x), np.uint8)
        for k, b in zip(reply["bucket"].to_pylist(), reply["bits"].to_pylist(), strict=True):
            bits[self.cut[k] : self.cut[k + 1]] = np.frombuffer(b, np.uint8)
        out, low = np.zeros(len(self.order), np.uint8), np.zeros(len(self.order), np.int64)
        out[self.order], low[self.order] = bits[self.at], self.low[self.at]
        return out, low


def _judge(contexts: bool):
    """For each key sent to a bucket a byte: 1 where a smaller id sent it too, 2 where its windows are wanted (contexts: x is a symbol and has several y)."""

    def judge(sent: pa.Table) -> pa.Table:
        size = np.array([len(b) // 8 for b in sent["ids"].to_pylist()], np.int64)
        both = [np.frombuffer(k, U64).reshape(2, -1) for k in sent["keys"].to_pylist()]
        x, y = (np.concatenate([b[i] for b in both]) for i in (0, 1))
        ids = np.concatenate([_from_planes(b) for b in sent["ids"].to_pylist()])
        order = np.lexsort((ids, y, x))
        x, y, ids = x[order], y[order], ids[order]
        new_x = np.append(True, x[1:] != x[:-1])
        new = new_x | np.append(True, y[1:] != y[:-1])
        least = ids[new][np.cumsum(new) - 1]
        bits = (ids > least).astype(np.uint8)
        if contexts:
            group = np.cumsum(new_x) - 1
            several = np.bincount(group, new) > 1
            first = np.flatnonzero(new_x)
            differ = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
            bits |= ((several & differ)[group] & (ids == least)).astype(np.uint8) * np.uint8(2)
        back = np.empty_like(bits)
        back[order] = bits
        cut = np.append(0, np.cumsum(size))
        give_back()
        return pa.table({"chunk": sent["chunk"].cast(pa.int64()), "bucket": sent["bucket"].cast(pa.int32()), "bits": pa.array([back[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    return judge


def without_repeats(docs: DataFrame, width: int = WIDTH, most: int = ROUNDS, texts: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words joined by single spaces as ``kept``) of documents (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(16, bytes_ // CHUNK), max(16, bytes_ // BUCKET)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    named = dealt.where("doc_id IS NOT NULL")
    schema = _RESULT + (", kept string" if texts else "")

    def entries(part: pa.Table) -> tuple[Entries, np.ndarray, Sending]:
        e = Entries(part["text"], width, most)
        ids = part["doc_id"].to_numpy()[e.row] if part.num_rows else np.zeros(0, np.int64)
        return e, ids, Sending(mix(e.sym), e.key, ids, buckets)

    def wanted(e: Entries, ids: np.ndarray, bits: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, Sending]:
        at = e.windows(np.flatnonzero((bits & 2 > 0) & (ids == low)))
        owner = np.searchsorted(e.a, at, side="right") - 1
        return at, Sending(e.words(0, at, at + width), e.words(1, at, at + width), ids[owner], buckets)

    def reveal(key: tuple, part: pa.Table) -> pa.Table:
        out = entries(part)[2].rows(key[0].as_py())
        give_back()
        return out

    def verify(key: tuple, part: pa.Table, reply: pa.Table) -> pa.Table:
        e, ids, sending = entries(part)
        out = wanted(e, ids, *sending.replies(reply))[1].rows(key[0].as_py())
        give_back()
        return out

    def remove(part: pa.Table, replies: pa.Table) -> pa.Table:
        e, ids, sending = entries(part)
        second = replies["second"].to_numpy(zero_copy_only=False).astype(bool)
        bits, low = sending.replies(replies.filter(pa.array(~second)))
        at, windows = wanted(e, ids, bits, low)
        found, least = windows.replies(replies.filter(pa.array(second)))
        owner = np.searchsorted(e.a, at, side="right") - 1
        hit = np.concatenate([e.windows(np.flatnonzero((bits & 1 > 0) | (low < ids))), at[(found & 1 > 0) | (least < ids[owner])]])
        edge = np.zeros(e.first[-1] + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        stay = np.cumsum(edge)[:-1] == 0
        return finished(part, stay, e.first)

    def finished(part: pa.Table, stay: np.ndarray | None, first: np.ndarray | None) -> pa.Table:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for i, text in enumerate(part["text"].cast(pa.large_binary()).to_pylist()):
            words = (text or b"").split()
            kept = words if stay is None else list(compress(words, stay[first[i] : first[i + 1]].tolist()))
            line = b" ".join(kept)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(line).hexdigest())
            if texts:
                out["kept"].append(line.decode())
        if not texts:
            del out["kept"]
        give_back()
        return pa.table({"doc_id": part["doc_id"].cast(pa.int64())} | {k: pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in out.items()})

    def plain(batches):
        for b in batches:
            yield from finished(pa.Table.from_batches([b]), None, None).to_batches()

    first_path, second_path = shared_dir(spark), shared_dir(spark)
    sent = named.groupBy("chunk").applyInArrow(reveal, _SENT)
    first = settled(sent.groupBy("bucket").applyInArrow(_judge(True), _REPLY), first_path)
    sent = named.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(verify, _SENT)
    second = settled(sent.groupBy("bucket").applyInArrow(_judge(False), _REPLY), second_path)
    replies = first.withColumn("second", F.lit(0)).unionByName(second.withColumn("second", F.lit(1)))
    out = named.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(remove, schema)
    path = shared_dir(spark)
    out = settled(out.unionByName(rows.where("doc_id IS NULL").mapInArrow(plain, schema)), path)
    dropped(spark, first_path, second_path)
    return out


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


ORACLE_OP12 = r"""
WITH words AS (
  SELECT rowid AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
),
windows AS (
  SELECT row, doc_id, i, list_slice(w, i, i + 12) AS seq FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
),
repeated AS (
  SELECT row, i FROM (SELECT row, doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS least FROM windows) WHERE least < doc_id
),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS at FROM repeated),
each_word AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM words),
kept AS (
  SELECT e.row, string_agg(word, ' ' ORDER BY e.at) AS line, count(*) AS n FROM each_word e LEFT JOIN gone g ON g.row = e.row AND g.at = e.at WHERE g.at IS NULL GROUP BY e.row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (row)
"""
