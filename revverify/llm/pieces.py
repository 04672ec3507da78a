"""Operator 2: SentencePiece BPE encoding by suffix-array matching, and decoding.

Texts are cut into chunks between bytes that no piece holds side by side, so no merge reaches over a cut, and each batch
works on its distinct chunks. Their bytes are laid end to end and all character positions sorted by the bytes that follow them, as far as
the longest piece: the suffix array. Every piece is looked up in it by binary search, which gives its range of
occurrences; each occurrence is an edge (position, length, piece), and the edges are sorted by position. The relaxation
then merges neighbours: in each round every chunk joins its best-scored adjacent pair that is an edge, the leftmost of equals, until none
is left. Symbols that are no piece fall back to byte pieces.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import U64, first_seen, mix, packed, pieces, span_hashes

_MARK = "▁"
_FAR = np.int64(1) << 40


class PieceModel:
    """A BPE SentencePiece model with identity normalisation and a dummy prefix, as arrays."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are read")
        self.unknown = sp.unk_id()
        self.byte_id = np.full(256, self.unknown, np.int64)
        self.text_of: list[bytes] = []
        words, ids, scores = [], [], []
        for i, p in enumerate(proto.pieces):
            raw = p.piece.replace(_MARK, " ").encode()
            if p.type == 6:
                raw = bytes([int(p.piece[3:5], 16)])
                self.byte_id[raw[0]] = i
            elif p.type in (2, 3):
                raw = b""
            elif p.type == 4 or len(raw) > 63:
                raise ValueError("models with user-defined pieces or pieces of 64 bytes and more are not read")
            elif p.type == 1:
                words.append(raw)
                ids.append(i)
                scores.append(p.score)
            else:
                raw = b" \xe2\x81\x87 " if p.type == 2 else raw
            self.text_of.append(raw)
        self.ids, self.length = np.array(ids), np.array([len(w) for w in words])
        _, self.rank = np.unique(-np.array(scores), return_inverse=True)
        self.words_of_key = max(1, -(-int(self.length.max()) // 8))
        pad = self.words_of_key * 8
        self.low = self._keys(words, pad, b"\0")
        self.high = self._keys(words, pad, b"\xff")
        # Two neighbouring bytes that no piece holds side by side: no merge reaches over them.
        self.apart = np.ones(1 << 16, bool)
        for w in words:
            raw = np.frombuffer(w, np.uint8).astype(np.int64)
            self.apart[raw[:-1] << 8 | raw[1:]] = False
        cont = np.arange(1 << 16) & 0xC0 == 0x80
        self.apart &= ~cont  # characters stay whole
        self.deep = np.unique(self.low[self.length > 8, 0])
        self.kind = np.uint16 if len(self.text_of) < 1 << 16 else np.uint32

    @staticmethod
    def _keys(words: list[bytes], pad: int, fill: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(w.ljust(pad, fill) for w in words), ">u8").astype(np.uint64).reshape(-1, pad // 8)

    def edges(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces at the character positions ``at``: sorted keys position * 64 + length, and piece numbers."""
        k = self.words_of_key
        room = np.concatenate([text, np.zeros(8 * k + 8, np.uint8)]).astype(np.uint64)
        first = np.zeros(len(room) - 7, np.uint64)
        for j in range(8):
            first |= room[j : j + len(first)] << np.uint64(56 - 8 * j)
        # Eight bytes settle the order, but for the positions where a longer piece may begin.
        order = np.argsort(first[at])
        head = first[at[order]]
        more = np.flatnonzero(np.isin(head, self.deep))
        sub = order[more]
        order[more] = sub[np.lexsort([first[at[sub] + 8 * j] for j in reversed(range(k))])]
        cols = [first[at[order] + 8 * j] for j in range(k)]

        def bound(keys: np.ndarray, above: bool) -> np.ndarray:
            lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(order))
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(order) - 1)
                less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
                for j in range(k):
                    x = cols[j][mid]
                    less |= same & (x < keys[:, j])
                    same &= x == keys[:, j]
                go = (less | same if above else less) & (lo < hi)
                lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
            return lo

        lo, hi = bound(self.low, False), bound(self.high, True)
        n = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(n)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        key = at[order[step]] * 64 + self.length[piece]
        by_position = np.argsort(key)
        return key[by_position], piece[by_position]

    def _chunk_ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks data[start:end] and how many each has. Their bytes are laid end to end, with a byte no text holds between them."""
        size = end - start
        begin = np.cumsum(size + 1) - size - 1
        text = np.full(int(size.sum()) + len(size), 0xFF, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(begin, size) + step] = data[np.repeat(start, size) + step]
        at = np.flatnonzero((text & 0xC0 != 0x80) & (text != 0xFF))
        key, piece = self.edges(text, at)
        rank_of = np.append(self.rank[piece], _FAR)

        def joined(pos: np.ndarray, length: np.ndarray) -> np.ndarray:
            """Rank of the piece at each place; far above all where there is none."""
            want = pos * 64 + np.minimum(length, 63)
            i = np.searchsorted(key, want)
            i[i == len(key)] = 0
            return np.where((key[i] == want) & (length < 64), rank_of[i], _FAR) if len(key) else np.full(len(pos), _FAR)

        pos, own = at, np.searchsorted(begin, at, side="right") - 1
        stop = np.append(at[1:], len(text))
        length = np.minimum(stop, (begin + size)[own]) - pos
        long = np.bincount(own, minlength=len(size)) > 256
        done = []
        for c in np.flatnonzero(long).tolist():
            i = own == c
            done.append(self._merge_long(pos[i], length[i], joined, c))
        keep = ~long[own]
        pos, own, length = pos[keep], own[keep], length[keep]
        while len(pos):
            best = np.full(len(pos), _FAR)
            pair = np.flatnonzero(own[1:] == own[:-1])
            best[pair] = joined(pos[pair], length[pair] + length[pair + 1])
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            low = np.minimum.reduceat(best, first)
            count = np.diff(np.append(first, len(pos)))
            over = np.repeat(low == _FAR, count)
            if over.any():
                done.append((pos[over], own[over], length[over]))
                pos, own, length, best = pos[~over], own[~over], length[~over], best[~over]
                if not len(pos):
                    break
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                count, low = count[low != _FAR], low[low != _FAR]
            hit = np.flatnonzero(best == np.repeat(low, count))
            hit = hit[np.concatenate([[True], own[hit][1:] != own[hit][:-1]])]  # the leftmost of each chunk
            length[hit] += length[hit + 1]
            stay = np.ones(len(pos), bool)
            stay[hit + 1] = False
            pos, own, length = pos[stay], own[stay], length[stay]
        pos, own, length = (np.concatenate([d[j] for d in done]) for j in range(3))
        order = np.argsort(pos)
        pos, own, length = pos[order], own[order], length[order]
        want = pos * 64 + np.minimum(length, 63)
        i = np.searchsorted(key, want)
        i[i == len(key)] = 0
        found = (key[i] == want) if len(key) else np.zeros(len(pos), bool)
        n = np.where(found, 1, length)
        ids = self.byte_id[text[np.repeat(pos, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]]
        whole = (np.cumsum(n) - n)[found]
        ids[whole] = self.ids[piece[i[found]]]
        return ids.astype(self.kind), np.bincount(own, n, len(size)).astype(np.int64)

    @staticmethod
    def _merge_long(pos: np.ndarray, length: np.ndarray, joined, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same merging for one long chunk, with a heap of pairs."""
        pos, length = pos.copy(), length.copy()
        n = len(pos)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        start = joined(pos[:-1], length[:-1] + length[1:])
        heap = [(int(r), i, int(length[i]), int(length[i + 1])) for i, r in enumerate(start) if r < _FAR]
        heapq.heapify(heap)
        alive = np.ones(n, bool)

        def offer(i: int) -> None:
            j = int(after[i])
            if i >= 0 and j < n:
                r = int(joined(pos[i : i + 1], length[i : i + 1] + length[j : j + 1])[0])
                if r < _FAR:
                    heapq.heappush(heap, (r, i, int(length[i]), int(length[j])))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or length[i] != a or after[i] >= n or length[after[i]] != b:
                continue
            j = int(after[i])
            alive[j] = False
            length[i] += length[j]
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(int(before[i]))
        return pos[alive], np.full(int(alive.sum()), chunk), length[alive]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts end to end, and the texts' offsets; a null or empty text has none."""
        data, offs = packed(texts)
        if _MARK.encode() in data.tobytes():  # the library does not tell it from a space
            texts = pa.array([(t or "").replace(_MARK, " ") for t in texts.to_pylist()])
            data, offs = packed(texts)
        size, docs = np.diff(offs), len(offs) - 1
        lead = (size > 0).astype(np.int64)
        doc = np.repeat(np.arange(docs), size)
        out = np.full(len(data) + int(lead.sum()), 0x20, np.uint8)
        out[np.arange(len(data)) + np.cumsum(lead)[doc]] = data
        new = offs + np.concatenate([[0], np.cumsum(lead)])
        cut = np.zeros(len(out) + 1, bool)
        cut[new] = True
        cut[1 : len(out)] |= self.apart[out[:-1].astype(np.int64) << 8 | out[1:]]
        start = np.flatnonzero(cut[: len(out)])
        end = np.append(start[1:], len(out))[: len(start)]
        owner = np.searchsorted(new, start, side="right") - 1
        # Equal chunks are encoded once: they agree in two independent 64-bit hashes and in their length.
        one, two = span_hashes(out, [(start, end)])[0], span_hashes(out[::-1], [(len(out) - end, len(out) - start)])[0]
        code, first = first_seen(mix(one) ^ two ^ mix((end - start).astype(U64)))
        ids, count = self._chunk_ids(out, start[first], end[first]) if len(first) else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        begin, count = (np.cumsum(count) - count)[code], count[code]
        total = np.concatenate([[0], np.cumsum(np.bincount(owner, count, docs).astype(np.int64))])
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return ids[np.repeat(begin, count) + step], total

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of one sequence: pieces' bytes in a row without the leading space; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join([self.text_of[i] for i in ids.tolist()])
        return raw[1:] if raw[:1] == b" " else raw


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Each row of docs with its piece ids and whether they decode to its text.

    docs must have ``text``; all columns but text are kept, and n_pieces, round_trip and ids (array) or, for ``digest``, ids_crc32
    (of little-endian 32-bit ids) are added in front of clashing names, which are dropped. U+2581 is the model's space mark and
    comes back as a space. Whole texts, whatever their length; null is read as empty and has no ids.
    """
    added = ["n_pieces", "round_trip", "ids_crc32" if digest else "ids"]
    kept = [c for c in docs.columns if c not in ("text", *added)]
    kind = F.lit(0).cast("long") if digest else F.array().cast("array<int>")
    schema = docs.select(*kept, F.lit(0).cast("long").alias(added[0]), F.lit(True).alias(added[1]), kind.alias(added[2])).schema

    def run(batches):
        m = model_of(path)
        for batch in batches:
            for x in pieces(batch, most=1 << 20):  # every part looks up all pieces once
                ids, offs = m.encode(x["text"])
                same, crc, rows = [], [], []
                for t, a, b in zip(x["text"], offs, offs[1:], strict=False):
                    raw = t.as_py() or ""
                    same.append(m.decode(ids[a:b]).decode("utf-8", "replace") == raw.replace(_MARK, " "))
                    if digest:
                        crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                    else:
                        rows.append(ids[a:b].astype(np.int32))
                last = pa.array(crc, pa.int64()) if digest else pa.array(rows, pa.list_(pa.int32()))
                yield pa.record_batch([*(x[c] for c in kept), pa.array(np.diff(offs)), pa.array(same), last], names=[*kept, *added])

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op2_piece_encoding(spark, sf_dir: str) -> DataFrame:
    """Every document's piece ids (count and checksum) and whether they decode to the whole text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)
