"""Operator 3: token ids in frequency-ranked, byte-aligned variable-length files.

A folder holds two Parquet tables. ``ranks`` (rank, id) lists the ids of the corpus by falling count, so the
commonest get the smallest numbers. ``segments`` holds runs of documents in ascending order:

    part, seq      place of the segment: part by part, seq by seq, doc_id ascends over the whole table
    before         ids in earlier segments of the part
    doc_id         ids of its documents
    n_tokens       length of each of them
    control        two bits for each number, four numbers to a byte, lowest bits first: bytes of the number, less one
    data           the numbers' bytes, little-endian, 1 to 4 each

Numbers are ranks. Reading takes the lengths of four numbers from a table of 256 rows by the control byte, sums
them to places in ``data`` and gathers the bytes, all in numpy.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bytesvec import Words, first_seen, packed, pieces, span_hashes
from .common import dropped, shared_dir, small_side, stored

#: Lengths of the four numbers that each control byte speaks of.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
SEGMENT_IDS = 1 << 18
#: A longer text is encoded part by part, cut at white space.
LONG = 4 << 20


def pack_numbers(x: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2^32."""
    x = x.astype("<u4")
    extra = (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    four = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    four[: len(x)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = x.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_numbers(control, data, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class IdTable:
    """Ids of spans already met, by the span's bytes. When it holds ``most`` spans, those met once only are forgotten."""

    def __init__(self, kind: type, most: int):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 18, self.kind), 0
        self.begin, self.size, self.again = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.again[: len(self.slot)])
        spans, old = list(self.slot), (self.flat, self.begin[keep], self.size[keep].astype(np.int64))
        self.clear()
        if len(keep) < self.most // 2:
            flat, begin, size = old
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            self._add([spans[i] for i in keep.tolist()], flat[np.repeat(begin, size) + step], size)

    def _add(self, spans: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        a, k = len(self.slot), len(sizes)
        while len(self.begin) < a + k:
            self.begin, self.size, self.again = (np.resize(x, 2 * len(x)) for x in (self.begin, self.size, self.again))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.begin[a : a + k], self.size[a : a + k], self.again[a : a + k] = self.used + np.cumsum(sizes) - sizes, sizes, False
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slot.update(zip(spans, range(a, a + k), strict=True))

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, ids_of) -> np.ndarray:
        """Slots of all spans; ``ids_of(start, end)`` gives flat ids and sizes of the distinct new ones."""
        code, first = first_seen(hashes)
        if len(self.slot) + len(first) > self.most:
            self._forget()
        raw = data.tobytes()
        keys = [raw[x:y] for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        get = self.slot.get
        slots = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(slots < 0)
        self.again[slots[slots >= 0]] = True
        if len(new):
            base = len(self.slot)
            flat, sizes = ids_of(start[first[new]], end[first[new]])
            self._add([keys[i] for i in new.tolist()], flat, sizes)
            slots[new] = np.arange(base, base + len(new))
        return slots[code] if len(code) else np.zeros(0, np.int64)

    def gather(self, slots: np.ndarray, owner: np.ndarray, docs: int, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans of each text in order, with ``end`` after each text unless None, and the texts' offsets."""
        size = self.size[slots].astype(np.int64)
        extra = 0 if end is None else 1
        offs = np.concatenate([[0], np.cumsum(np.bincount(owner, size, docs).astype(np.int64) + extra)])
        ids = np.full(offs[-1], end or 0, self.kind)
        step = np.arange(int(size.sum()))
        inner = step - np.repeat(np.cumsum(size) - size, size)
        ids[step + extra * np.repeat(owner, size)] = self.flat[np.repeat(self.begin[slots], size) + inner]
        return ids, offs


_LETTER, _DIGIT, _MARK = 1, 2, 3
#: What each byte surely is by itself; 0 leaves open what it is (the apostrophe begins endings like 's).
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = _MARK


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a letter from U+00C0 to U+024F (but for the two signs in between) are letters."""
    out = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    out[lead] = out[lead + 1] = _LETTER
    return out


_PLAIN = np.zeros(256, np.int64)
_PLAIN[[*range(65, 91), *range(97, 123)]] = 1


def _parts(raw: bytes) -> list[bytes]:
    """The text in parts of about LONG bytes, each but the last up to a white space."""
    out, at = [], 0
    while len(raw) - at > LONG:
        found = [x.start() for x in [_BREAK.search(raw, at + LONG)] if x]
        if not found:
            break
        out.append(raw[at : found[0]])
        at = found[0]
    return [*out, raw[at:]]


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


class WordEncoder:
    """Ids of whole texts, run by run, for a tokenizer that drops white space, folds A-Z and takes runs of letters, single digits and
    runs of other signs apart: each distinct run goes through the tokenizer once. Runs are cut between two bytes
    whose classes are sure and differ; anything else stays in one run, which the tokenizer cuts itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.kind = np.uint16 if len(vocab) < 1 << 16 else np.uint32
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known = IdTable(self.kind, 200_000)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of plain letters go through in one text for many, cut again after each token that ends a word."""
        size = end - start
        letters = np.concatenate([[0], np.cumsum(_PLAIN[data])])
        is_plain = letters[end] - letters[start] == size
        plain, rest = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        n = size[plain]
        joined = np.full(int(n.sum()) + len(n), 0x20, np.uint8)
        place = np.cumsum(n + 1) - n - 1
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        joined[np.repeat(place, n) + step] = data[np.repeat(start[plain], n) + step]
        text = joined.tobytes().decode("ascii")
        cuts = [*place[::256].tolist(), len(text)]
        flat = [np.array(x, self.kind) for x in self._encode([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])]
        flat = np.concatenate(flat) if flat else np.zeros(0, self.kind)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(plain):
            raise ValueError("this tokenizer does not mark the ends of words")
        others = self._encode([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
        sizes = np.zeros(len(size), np.int64)
        sizes[plain] = np.diff(np.concatenate([[0], ends]))
        sizes[rest] = [len(x) for x in others]
        place = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), self.kind)
        where = np.repeat(place[plain] - np.concatenate([[0], ends])[:-1], sizes[plain])
        out[where + np.arange(len(flat))] = flat
        n = sizes[rest]
        out[np.repeat(place[rest] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = np.array([i for x in others for i in x], self.kind)
        return out, sizes

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end`` after each text, and the offsets of the texts in them."""
        if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_buffer()) > LONG:
            parts = [self._encode_packed(*packed(pa.array([p])), None)[0] for p in _parts(texts[0].as_buffer().to_pybytes())]
            ids = np.concatenate([*parts, np.array([end], self.kind)])
            return ids, np.array([0, len(ids)])
        return self._encode_packed(*packed(texts), end)

    def _encode_packed(self, data: np.ndarray, offs: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        # Special tokens are found in the text as it stands: words stay whole where their brackets are about.
        special = b"<|" in data.tobytes()
        words = Words(data, offs, lower=not special)
        start, stop, owner = words.start, words.end, words.text
        if not special and len(data):
            kind = _classes(words.data)
            cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
            cut = cut[~np.isin(cut, offs)]
            start, stop = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
            owner = np.searchsorted(offs, start, side="right") - 1
        hashes = span_hashes(words.data, [(start, stop)])[0]
        slots = self.known.lookup(words.data, start, stop, hashes, lambda a, b: self._ids(words.data, a, b))
        return self.known.gather(slots, owner, len(offs) - 1, end)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker; tasks that follow find the words of those before."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """A row (doc_id, ids) for each row (doc_id, text): ids as little-endian numbers of the vocabulary's width."""

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for x in pieces(batch, most=1 << 20):
                ids, offs = e.encode(x["text"], end)
                rows = [ids[a:b].tobytes() for a, b in zip(offs, offs[1:], strict=False)]
                yield pa.record_batch([x["doc_id"], pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 1) -> None:
    """Write the ids of all documents (doc_id, text) to ``path`` in ascending doc_id order (null first; rows of one doc_id in the order of a hash of their ids,
    so that runs agree).

    A null or empty text has the end id alone, an empty table makes files without rows, other columns are not looked at, and texts of any length are
    encoded whole, part by part. The tokenizer must be of the kind that WordEncoder tells, as
    word_bpe_49k.json is. Counts are taken over the whole corpus; the rank table is as long as the vocabulary at most.
    """
    spark = docs.sparkSession
    width = np.dtype(encoder(tokenizer).kind)
    own = shared_dir(spark)
    tokens = stored(encoded(docs, tokenizer, end), own)

    def counted(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in pieces(batch, "ids"):
                got = np.bincount(np.frombuffer(packed(x["ids"])[0].tobytes(), width))
                if len(got) > len(total):
                    total, got = got, total
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    ranks = tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [x["id"] for x in sorted(ranks.collect(), key=lambda x: (-x["n"], x["id"]))]
    spark.createDataFrame(list(enumerate(order)), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order))

    def segments(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs_, sizes, parts, held = [], [], [], 0

        def flush():
            nonlocal seq, before, docs_, sizes, parts, held
            control, data = pack_numbers(rank_of[np.concatenate(parts)])
            row = [[part], [seq], [before], [docs_], [sizes], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            out = pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "before", "doc_id", "n_tokens", "control", "data"])
            seq, before = seq + 1, before + held
            docs_, sizes, parts, held = [], [], [], 0
            return out

        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                x = np.frombuffer(ids.as_buffer(), width).copy()  # a view would hold the whole batch
                docs_.append(doc)
                sizes.append(len(x))
                parts.append(x)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield flush()
        if docs_:
            yield flush()

    n = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    # Rows that agree in doc_id and ids are told apart by their place in the stored table, so that no group of them has to fit one task.
    order = ["doc_id", F.xxhash64("ids"), F.monotonically_increasing_id()]
    tokens = tokens.select("doc_id", order[1].alias("tie"), order[2].alias("place"), "ids")
    placed = tokens.repartitionByRange(max(1, -(-n // (32 << 20))), "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    schema = "part int, seq int, before long, doc_id array<long>, n_tokens array<long>, control binary, data binary"
    placed.select("doc_id", "ids").mapInArrow(segments, schema).write.parquet(f"{path}/segments")
    dropped(spark, own)


def read_token_files(spark, path: str, digest: bool = False) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), n_tokens, and ids or, for ``digest``, ids_crc32."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(len(ranks) or 1, np.uint32)
    for x in ranks:
        id_of[x["rank"]] = x["id"]
    segments = spark.read.parquet(f"{path}/segments")
    sums = segments.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    # One row for each part of 32 MB: the ids of all parts before it.
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                sizes = row["n_tokens"].values.to_numpy(zero_copy_only=False)
                ids = id_of[unpack_numbers(row["control"].as_buffer(), row["data"].as_buffer(), int(sizes.sum()))]
                at = np.concatenate([[0], np.cumsum(sizes)])
                if digest:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))
                starts = at[:-1] + row["before"].as_py() + row["base"].as_py()
                yield pa.record_batch([row["doc_id"].values, pa.array(starts), pa.array(sizes), last], names=["doc_id", "start", "n_tokens", "last"])

    rows = segments.join(small_side(base, base.count()), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, last {'long' if digest else 'array<long>'}")
    return rows.withColumnRenamed("last", "ids_crc32" if digest else "ids")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the token files of the whole corpus, read back from them."""
    import public_tokenizers

    path = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path, digest=True)
