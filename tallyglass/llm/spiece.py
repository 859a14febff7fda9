"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces of a model file, with their scores read as log scores, sit in a double-array trie over
UTF-8 bytes. A text gets the path of the highest total score; a code point that no piece covers
costs the lowest score less UNKNOWN_PENALTY and becomes its bytes. A space is the marker U+2581,
and one marker is put before the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import map_batches

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_CHUNKS, CACHED_CHARS = 400_000, 48
#: Fixed values of the model file format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class DoubleArrayTrie:
    """Byte strings to numbers. From node s, byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        start = 1
        rows = sorted(zip(keys, values))
        todo = [(0, 0, 0, len(rows))]  # node, depth, rows
        while todo:
            node, depth, lo, hi = todo.pop()
            if lo < hi and len(rows[lo][0]) == depth:
                self.value[node] = rows[lo][1]
                lo += 1
            kids: list[tuple[int, int, int]] = []
            while lo < hi:
                c, to = rows[lo][0][depth], lo
                while to < hi and rows[to][0][depth] == c:
                    to += 1
                kids.append((c, lo, to))
                lo = to
            if not kids:
                continue
            slot, taken = max(kids[0][0] + 1, start), 0  # a slot for the first child, and so a base
            while True:
                b = slot - kids[0][0] - 1
                if b + 258 > len(self.check):
                    more = len(self.check)
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if self.check[slot] != -1:
                    taken += 1
                elif all(self.check[b + c + 1] == -1 for c, _, _ in kids):
                    break
                slot += 1
            if taken > 0.9 * (slot - start + 1):  # nearly full up to here: do not look there again
                start = slot
            self.base[node] = b
            for c, first, last in kids:
                self.check[b + c + 1] = node
                todo.append((b + c + 1, depth + 1, first, last))
        for column, blank in ((self.base, 0), (self.check, -1), (self.value, -1)):
            column += [blank] * 257  # no step leads beyond the end

    def prefixes(self, text: bytes, at: int = 0) -> list[tuple[int, int]]:
        """(end, value) of every key that starts at ``at``, shortest first."""
        node, out = 0, []
        for end in range(at, len(text)):
            to = self.base[node] + text[end] + 1
            if self.check[to] != node:
                break
            node = to
            if self.value[node] >= 0:
                out.append((end + 1, self.value[node]))
        return out


class _Chunks(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        value = self.make(MARK + chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = value
        return value


class Unigram:
    """Encoder and decoder over (piece, score, kind) rows."""

    def __init__(self, rows: list[tuple[str, float, int]]):
        self.rows = rows
        usable = [(p.encode(), i) for i, (p, _, kind) in enumerate(rows) if kind in (NORMAL, USER_DEFINED) and p]
        self.trie = DoubleArrayTrie([p for p, _ in usable], [i for _, i in usable])
        self.scores = [s for _, s, _ in rows]
        self.unknown_score = min((s for _, s, kind in rows if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, r in enumerate(rows) if r[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(rows) if kind == BYTE}
        self.is_byte = np.array([kind == BYTE for _, _, kind in rows])
        self.raw = [
            bytes([int(p[3:5], 16)]) if kind == BYTE
            else b"" if kind == CONTROL
            else " ⁇ ".encode() if kind == UNKNOWN
            else p.replace(MARK, " ").encode()
            for p, _, kind in rows
        ]
        #: A text may be cut before a marker if no piece holds a marker after something else.
        self.cuts = not any(MARK in p.lstrip(MARK) for p, _, kind in rows if kind in (NORMAL, USER_DEFINED))
        self.chunks = _Chunks(self.viterbi)

    def viterbi(self, text: str) -> bytes:
        """Ids of the best path through a text in which spaces are markers, as little-endian 32-bit integers."""
        raw = text.encode()
        n, low = len(raw), float("-inf")
        best, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        at = 0
        while at < n:  # code point by code point; the trie is walked in place, as this is the hot loop
            lead, here, node = raw[at], best[at], 0
            whole = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            single = False
            for end in range(at, n):
                to = base[node] + raw[end] + 1
                if check[to] != node:
                    break
                node = to
                i = value[to]
                if i >= 0:
                    end += 1
                    score = here + scores[i]
                    if score > best[end]:
                        best[end], back[end], piece[end] = score, at, i
                    if end == whole:
                        single = True
            if not single and here + self.unknown_score > best[whole]:
                best[whole], back[whole], piece[whole] = here + self.unknown_score, at, -1
            at = whole
        ids: list[int] = []
        while n:
            if piece[n] >= 0:
                ids.append(piece[n])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(raw[back[n] : n])]
            elif ids[-1:] != [self.unknown]:
                ids.append(self.unknown)
            n = back[n]
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self.viterbi(MARK + text.replace(" ", MARK))
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return b"".join(map(self.viterbi, _CHUNK.findall(MARK + text.replace(" ", MARK))))
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> str:
        """The text: markers are spaces again, byte pieces join to code points, the first space is dropped."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", errors="replace").removeprefix(" ")


def load(vocabulary: str = VOCABULARY) -> list[tuple[str, float, int]]:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


@lru_cache(maxsize=2)
def unigram(vocabulary: str = VOCABULARY) -> Unigram:
    """One encoder for each worker process."""
    return Unigram(load(vocabulary))


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int), byte_pieces, decoded for every row, over whole texts.

    NULL and empty texts have no ids and decode to the empty text; repeated rows come back as often;
    an empty table gives no rows. Only doc_id and text are read, so other columns cannot clash. A
    text that holds the marker itself decodes to one with a space there.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(vocabulary)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            arrays = [np.frombuffer(i, dtype="<i4") for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(arrays, pa.list_(pa.int32())),
                 pa.array([int(model.is_byte[a].sum()) for a in arrays], pa.int64()),
                 pa.array([model.decode(i) for i in ids], pa.string())],
                ["doc_id", "ids", "byte_pieces", "decoded"],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_batches(src, encode, f"doc_id {kind}, ids array<int>, byte_pieces long, decoded string")


def digest_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_ids, byte_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_crc32, round_trip for every row.

    Encodes and decodes like ``encode_documents`` but keeps digests only.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column(1).to_pylist():
                ids = model.encode(t or "")
                back = model.decode(ids)
                bytes_ = int(model.is_byte[np.frombuffer(ids, dtype="<u4")].sum())
                out.append((len(ids) // 4, bytes_, zlib.crc32(ids), zlib.crc32(back.encode()), back == (t or "")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            cols = [pa.array([o[k] for o in out], x) for k, x in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cols], ["doc_id", "n_ids", "byte_pieces", "ids_crc32", "decoded_crc32", "round_trip"]
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return map_batches(src, encode, schema)
