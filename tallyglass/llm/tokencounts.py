"""Token counts per section by offsets.

A document is encoded once, as a whole. Every token has the span of the code points that its bytes
belong to; sections are consecutive spans; an interval join of the two gives each token its section.
Rule for a token that crosses a boundary: it belongs to the section that holds most of its code
points, to the earliest of these on a tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.bpe import UNSAFE, VOCABULARY, ByteBpe, _Chunks
from tallyglass.llm.common import map_batches


class OffsetBpe(ByteBpe):
    """Byte-level BPE with the span of each token in code points."""

    def __init__(self, vocabulary: str = VOCABULARY):
        super().__init__(vocabulary)
        self.widths = self.width.tolist()  # no token has more than 255 bytes
        self.first, self.rest = _Chunks("", self._chunk_widths), _Chunks(" ", self._chunk_widths)

    def _chunk_widths(self, chunk: str) -> bytes:
        return bytes([self.widths[i] for i in self.fast.encode_ordinary(chunk)])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all tokens of a whole text, in code points.

        Tokens follow each other byte for byte, so their byte offsets are running sums of their widths.
        """
        if UNSAFE.search(text) or any(s in text for s in self.special):
            widths = bytes([self.widths[i] for i in self.slow.encode(text, add_special_tokens=False).ids])
        else:
            head, *tail = text.split(" ")
            widths = self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        width = np.frombuffer(widths, dtype=np.uint8)
        ends = np.cumsum(width, dtype=np.int64)
        starts, last = ends - width, ends - 1
        raw = text.encode()
        if len(raw) != len(text):
            char = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) - 1  # of each byte
            starts, last = char[starts], char[last]
        return starts, last + 1


@lru_cache(maxsize=2)
def offset_bpe(vocabulary: str = VOCABULARY) -> OffsetBpe:
    """One encoder for each worker process."""
    return OffsetBpe(vocabulary)


def line_ends(text: str) -> np.ndarray:
    """Sections are lines, each with its line feed: where each ends. An empty text is one empty section."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = np.flatnonzero(c == 10) + 1
    return ends if len(ends) and ends[-1] == len(c) else np.append(ends, len(c))


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those among them that cross a boundary; ``bounds`` are the sections' ends."""
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    for i in crossing:
        edges = np.clip(np.concatenate([[starts[i]], bounds[first[i] : last[i] + 1]]), starts[i], ends[i])
        first[i] += int(np.diff(edges).argmax())  # the first of the largest
    n = len(bounds)
    return np.bincount(first, minlength=n), np.bincount(first[crossing], minlength=n)


def token_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sections: Callable[[str], np.ndarray] = line_ends,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """doc_id, section (from 0), start, end, n_tokens, n_crossing: one row per section of every row.

    ``sections`` gives the ascending ends of a text's consecutive sections; the last is its length.
    The counts of a document add up to its tokens. NULL and empty texts are one section without
    tokens; repeated rows come back as often; a token that two sections share equally goes to the
    earlier; very long texts are encoded whole; an empty table gives no rows. Only doc_id and text
    are read, so other columns cannot clash.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = offset_bpe(vocabulary)
        for batch in batches:
            many, cols = [], [[], [], [], [], []]
            for t in batch.column(1).to_pylist():
                t = t or ""
                bounds = sections(t)
                tokens, crossing = attribute(*bpe.spans(t), bounds) if t else (np.zeros(len(bounds), int),) * 2
                many.append(len(bounds))
                start = np.concatenate([[0], bounds[:-1]])
                for column, x in zip(cols, (np.arange(len(bounds)), start, bounds, tokens, crossing)):
                    column.append(x)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), many)))
            made = [pa.array(np.concatenate(c).astype(np.int64)) for c in cols]
            yield pa.RecordBatch.from_arrays([keys, *made], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long"
    return map_batches(src, count, schema)


def field_counts(df: DataFrame, fields: list[str], key: str, joint: str = "\n", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, field, n_tokens, n_crossing: the fields of a row joined by ``joint``, encoded once, counted per field.

    The joint belongs to the field before it. NULL and empty fields have only that; ties go to the
    earlier field; very long fields are encoded whole; a field that is named twice comes twice;
    repeated rows come back as often; an empty table gives no rows. Only ``key`` and ``fields`` are
    read, so other columns cannot clash.
    """
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    text = F.concat(*[x for v in values for x in (v, F.lit(joint))][:-1])
    ends, at = [], F.lit(0)
    for k, v in enumerate(values):
        at = at + F.length(v) + (len(joint) if k < len(values) - 1 else 0)
        ends.append(at)
    src = df.select(F.col(key).alias("key"), text.alias("text"), F.array(*ends).alias("ends"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = offset_bpe(vocabulary)
        for batch in batches:
            tokens, crossing = [], []
            for t, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                both = attribute(*bpe.spans(t), np.array(e)) if t else (np.zeros(len(e), int),) * 2
                tokens.append(both[0])
                crossing.append(both[1])
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(fields))))
            made = [pa.array(np.concatenate(c).astype(np.int64)) for c in (tokens, crossing)]
            names = pa.array(fields * batch.num_rows)
            yield pa.RecordBatch.from_arrays([keys, names, *made], ["key", "field", "n_tokens", "n_crossing"])

    kind = src.schema["key"].dataType.simpleString()
    return map_batches(src, count, f"key {kind}, field string, n_tokens long, n_crossing long")
