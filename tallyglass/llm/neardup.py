"""Near-duplicate removal: MinHash signatures in an LSH forest, confirmed on full shingle sets.

* A document's set: hashes of its distinct word shingles. Documents with equal sets are one class,
  and only one member of a class goes on.
* The forest: sorted orders of the signature's values. In an order, classes whose longest common
  prefix reaches a depth are a region, and the rows of a region are candidates of each other if the
  whole signatures are alike. The depth adapts to the region: one of more than REGION rows is not
  compared at this depth, its rows go on to the next of LEVELS, whose longer prefixes part them over
  more orders.
* First every row of a region gets one edge, to the most alike of the rows before it, and regions
  beyond REGION are sorted on, so that long common prefixes meet in runs of RUN rows. These edges are
  confirmed on full sets, and what is linked gets one label. Only regions that still hold several
  labels, and like pairs that no edge stands for, are looked at again: a row outside a region's main
  label is compared with the rows of other labels that it is like, and where these are many, with all
  of their label, so that the label's sets move once and not once a pair. Where rows of many labels
  are like each other, as in a crowd just below the threshold, their sets move once for the region.
* So near copies in any number become one label from a few edges a row, unlike documents in any
  number part by depth, and a pair that is like is never left out for being one of many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import binary_rows, map_batches, stored
from tallyglass.llm.graph import components

SHINGLE_WORDS, PERCENT = 5, 80
#: Values of a signature.
VALUES = 256
#: (depth, orders): of two sets at 0.8 all orders of a level miss 1 in 10,000 or fewer; the first level 1 in 10 million.
LEVELS = ((4, 32), (8, 96), (12, 256), (16, 512))
#: The most rows of a region that are compared at its depth.
REGION = 512
#: Rows that are compared in runs, and the orders in which regions beyond REGION are cut into runs.
RUN, RUN_ORDERS = 256, 4
#: Rows of one label that a row is compared with one by one; if it is like more of them it asks for the whole label.
FEW = 4
#: Like pairs a row from which on a cell's rows are compared on full sets together, if these have up to CELL_SHINGLES.
DENSE, CELL_SHINGLES = 4, 4_000_000
#: Askers, and rows of a label, that meet in one task.
ASKERS = 2048
#: Tasks over which the rows of one region are spread where its numbers are joined to them.
SALTS = 16
#: Signatures of candidates may agree in this many standard errors less than at the threshold: 3 in a million miss.
SPREADS = 4.5
#: Bits of the filter on ids that keeps most texts out of the shuffle; at most 1/64 of them are rows of a broadcast.
FILTER_BITS = 1 << 26
#: Words whose hashes a worker keeps; a worker lives on after its task, and so does what it keeps.
CACHED_WORDS = 1 << 16

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_DEEPEST, _MOST_ORDERS = LEVELS[-1]
#: The values that each order sorts by; the first four of the orders of the first level are disjoint.
_ORDERS = np.array(
    [
        [*own, *_rng.permutation(np.setdiff1d(np.arange(VALUES), own))[: _DEEPEST - len(own)]]
        for own in ([*range(4 * t, 4 * t + 4)] if t < LEVELS[0][1] else [] for t in range(_MOST_ORDERS))
    ],
    dtype=np.int64,
)
#: The lowest bits of a region's key are the number of its order.
_ORDER_BITS = np.uint64(_MOST_ORDERS - 1)
_ONES = np.uint64(0x1111111111111111)
#: Regions of up to this many rows are compared together.
_SMALL = 9


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text.

    Words are runs without white space, A-Z in lower case; a text of fewer words is one shingle; a
    text without words has none.
    """
    found = (text or "").encode().lower().split()
    h = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(h))
    if not width:
        return h
    out, last = np.zeros(len(h) - width + 1, dtype=np.uint64), len(h) - width + 1
    for k in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + last] + np.uint64(k + 1))
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """One byte of the minimum of each of VALUES hash functions over a non-empty set."""
    half = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for lo in range(0, len(half), 512):
        np.minimum(least, (half[lo : lo + 512, None] * _A + _B).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def set_name(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
    return int(h1), int(h2)


def signed_documents(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2 (the set's name; NULL for an empty one), sig."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, sigs = [], [], []
            for t in batch.column(2).to_pylist():
                own = shingles(t, words)
                sizes.append(len(own))
                names.append(set_name(own) if len(own) else (None, None))
                sigs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 *(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)), pa.array(sigs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig"],
            )

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_batches(src, sign, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary")


# --- regions


def _values(column: pa.Array, width: int = VALUES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def region_keys(sig: np.ndarray, depth: int, orders: int) -> np.ndarray:
    """Of each row and order, a 64-bit key of the first ``depth`` values and the order's number."""
    h = np.zeros((len(sig), orders), dtype=np.uint64)
    for k in range(depth):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, _ORDERS[:orders, k]] + np.uint64(k + 1))
    return ((h & ~_ORDER_BITS) | np.arange(orders, dtype=np.uint64)).view(np.int64)


def companies(classes: DataFrame, depth: int, orders: int) -> DataFrame:
    """(key, cid, rows) of every region of two rows or more at a depth; ``rows`` is the region's size."""

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = region_keys(_values(batch.column(1)), depth, orders)
            ids = np.repeat(batch.column(0).to_numpy(), orders)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "cid"])

    keys = map_batches(classes.select("cid", "sig"), to_keys, "key long, cid long")
    rows = keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    return keys.join(rows, "key")


def with_halves(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the set's size and the signature at four bits a value, for comparisons."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _values(batch.column(2)) & 15
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), binary_rows((v[:, 0::2] << 4) | v[:, 1::2])], ["cid", "size", "halves"]
            )

    own = map_batches(classes.select("cid", F.col("n").alias("size"), "sig"), halve, "cid long, size long, halves binary")
    return rows.join(own.hint("merge"), "cid")


def least_equal(percent: int) -> int:
    """Half-bytes that the signatures of candidates must have in common."""
    p = percent / 100 + (1 - percent / 100) / 16
    return math.floor(VALUES * p - SPREADS * math.sqrt(VALUES * p * (1 - p)))


def equal_halves(x: np.ndarray) -> np.ndarray:
    """Equal half-bytes of two signatures from their exclusive or, along the last axis."""
    x = x | (x >> np.uint64(1))
    x |= x >> np.uint64(2)
    return VALUES - np.bitwise_count(x & _ONES).sum(axis=-1, dtype=np.int32)


class Alike:
    """Whether rows (size, signature) can be linked: sizes exactly, signatures within SPREADS."""

    def __init__(self, size: np.ndarray, words: np.ndarray, percent: int):
        self.size, self.words, self.percent, self.least = size, words, percent, least_equal(percent)

    def __call__(self, i, j) -> tuple[np.ndarray, np.ndarray]:
        """(like, equal half-bytes) of rows i and j (one of them may be a single row)."""
        same = equal_halves(self.words[i] ^ self.words[j])
        low, high = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        return (same >= self.least) & (100 * low >= self.percent * high), same


def first_edges(key: np.ndarray, ids: np.ndarray, alike: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (key, id): edges (a, b) of each b to the most alike a < b, and the keys of
    regions that hold like pairs besides. Of equally alike rows the first is taken."""
    edge = np.flatnonzero(np.diff(key)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    none = np.zeros(0, np.int64)
    a, b, same = [none], [none], [none]
    small = np.repeat(hi - lo <= _SMALL, hi - lo)
    for g in range(1, _SMALL):
        at = np.flatnonzero((key[:-g] == key[g:]) & small[:-g])
        if not len(at):
            break
        like, equal = alike(at, at + g)
        a.append(at[like])
        b.append(at[like] + g)
        same.append(equal[like])
    a, b, same = (np.concatenate(x) for x in (a, b, same))
    order = np.lexsort((a, -same, b))
    a, b = a[order], b[order]
    new = np.ones(len(b), dtype=bool)
    new[1:] = b[1:] != b[:-1]
    first, second, left = [a[new]], [b[new]], [key[b[~new]]]
    for start, end in zip(lo[hi - lo > _SMALL].tolist(), hi[hi - lo > _SMALL].tolist()):
        for i in range(start + 1, end):
            like, equal = alike(slice(start, i), i)
            if like.any():
                first.append(np.array([start + int(np.where(like, equal, -1).argmax())]))
                second.append(np.array([i]))
                if like.sum() > 1:
                    left.append(key[start : start + 1])
    return ids[np.concatenate(first)], ids[np.concatenate(second)], np.unique(np.concatenate(left))


def whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by their first column, cut so that no value of it is split.

    The last column holds signatures; it comes as rows of unsigned 64-bit words.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
        columns.append(np.ascontiguousarray(_values(batch.columns[-1], VALUES // 2)).view(np.uint64))
        key = columns[0]
        if held and held[-1][0][-1] != key[0]:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        changes = np.flatnonzero(key[1:] != key[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns])]
            held, columns = [], [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


_FOUND = "a long, b long, left long"


def _found(a: np.ndarray, b: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
    """Edges, and keys of regions that hold more of them."""
    none = [pa.nulls(n, pa.int64()) for n in (len(a), len(left))]
    columns = [pa.concat_arrays([pa.array(x, pa.int64()), none[1]]) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([none[0], pa.array(left, pa.int64())])], ["a", "b", "left"])


def edges_of_regions(company: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """First edges of the regions of up to REGION rows, and the keys of those with like pairs besides."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, size, words in whole_regions(batches):
            yield _found(*first_edges(key, ids, Alike(size, words, percent)))

    rows = with_halves(company.where(F.col("rows") <= REGION).select("key", "cid"), classes)
    rows = rows.select("key", "cid", "size", "halves").repartition("key").sortWithinPartitions("key", "cid")
    return map_batches(rows, compare, _FOUND, rows=8192)


def edges_of_runs(company: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """First edges within runs of RUN rows of the regions beyond REGION, sorted on in RUN_ORDERS orders."""

    def sort_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            order = _ORDERS[(key.view(np.uint64) & _ORDER_BITS).astype(np.int64)]
            sig = np.take_along_axis(_values(batch.column(3)), order, axis=1)
            v = _values(batch.column(3)) & 15
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), binary_rows(sig), binary_rows((v[:, 0::2] << 4) | v[:, 1::2])],
                ["key", "cid", "size", "prefix", "halves"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # slices of RUN rows
            key, ids, size = (batch.column(i).to_numpy() for i in (0, 1, 2))
            words = np.ascontiguousarray(_values(batch.column(3), VALUES // 2)).view(np.uint64)
            order = np.lexsort((ids, key))
            a, b, _ = first_edges(key[order], ids[order], Alike(size[order], words[order], percent))
            yield _found(a, b, key[:0])

    order = F.col("key").bitwiseAND(F.lit(int(_ORDER_BITS)))
    rows = company.where((F.col("rows") > REGION) & (order < RUN_ORDERS)).select("key", "cid")
    rows = rows.join(classes.select("cid", F.col("n").alias("size"), "sig").hint("merge"), "cid").select("key", "cid", "size", "sig")
    rows = map_batches(rows, sort_key, "key long, cid long, size long, prefix binary, halves binary")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "key", "prefix", "cid").sortWithinPartitions("key", "prefix", "cid")
    return map_batches(rows.select("key", "cid", "size", "halves"), compare, _FOUND, rows=RUN)


def mixed_regions(company: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, label, rows, strays, main) of the regions that hold several labels.

    ``main`` is the label of most of a region's rows, ``strays`` the number of the others.
    """
    named = company.select("key", "cid").join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    salt = F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int").alias("salt")
    named = named.select("key", "cid", F.coalesce("label", "cid").alias("label"), salt)
    per_label = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    per = per_label.groupBy("key").agg(
        F.sum("c").alias("rows"), (F.sum("c") - F.max("c")).alias("strays"), F.max_by("label", F.struct("c", "label")).alias("main")
    )
    salted = per.where("strays > 0").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return named.join(salted, ["key", "salt"]).drop("salt")


def crowded() -> Column:
    """Regions of ``mixed_regions`` that are not compared at their depth."""
    return (F.col("rows") > REGION) & (F.col("strays") > REGION)


def cells(mixed: DataFrame, last: bool) -> DataFrame:
    """(cell, cid, label, asked): what is compared in one task, ``asked`` rows with all of a cell.

    A region of up to REGION rows is one cell, in which the strays ask. In a larger one with fewer
    strays, the rows of the main label are dealt into cells and each stray asks in all of them. Others
    are left to the next level; at the last one each pair of their blocks is a cell.
    """
    blocks = F.ceil(F.col("rows") / REGION).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(3)), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    stray = F.col("label") != F.col("main")
    to = F.when(F.col("rows") <= REGION, F.array(F.lit(0))).when(~crowded(), F.when(stray, every).otherwise(F.array(own)))
    if last:
        pairs = F.transform(every, lambda j: (F.least(own, j) * blocks + F.greatest(own, j)).cast("int"))
        to = to.otherwise(pairs)
    rows = mixed if last else mixed.where(~crowded())
    cell = F.when(F.col("rows") <= REGION, F.col("key")).otherwise(F.xxhash64("key", "block"))
    rows = rows.select("key", "cid", "label", "rows", stray.alias("asked"), F.explode(to).alias("block"))
    return rows.select(cell.alias("cell"), "cid", "label", "asked")


def pairs_of_cell(ids: np.ndarray, label: np.ndarray, asked: np.ndarray, alike: Alike) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Like pairs of the asked rows with rows of other labels; a label with more than FEW of them is asked for instead."""
    pairs, asks = [np.zeros((0, 2), np.int64)], []
    at = np.arange(len(ids))
    for i in np.flatnonzero(asked).tolist():
        others = at[(label != label[i]) & (~asked | (at < i))]
        others = others[alike(others, i)[0]]
        names, which, many = np.unique(label[others], return_inverse=True, return_counts=True)
        asks += [(int(ids[i]), name) for name in names[many > FEW].tolist()]
        found = ids[others[many[which] <= FEW]]
        pairs.append(np.stack([np.minimum(found, ids[i]), np.maximum(found, ids[i])], axis=1))
    return np.concatenate(pairs), asks


_PAIRED = "a long, b long, left long, cell long, asked boolean"


def pairs_of_cells(cells: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of each cell: like pairs (a, b) between labels, asks (a, left) of a row for a label, and if pairs
    are more than DENSE a row, instead of them the rows (a, left, cell, asked) that are in one."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, label, asked, size, words in whole_regions(batches):
            edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            pairs, asks, dense = [np.zeros((0, 2), np.int64)], set(), [np.zeros(0, np.int64)]
            for lo, hi in zip(edge, edge[1:]):
                own = slice(lo, hi)
                found, asking = pairs_of_cell(ids[own], label[own], asked[own], Alike(size[own], words[own], percent))
                asks.update(asking)
                members = lo + np.flatnonzero(np.isin(ids[own], found))
                if len(found) > DENSE * len(members) and size[members].sum() <= CELL_SHINGLES:
                    dense.append(members)
                else:
                    pairs.append(found)
            two, rows, asks = np.unique(np.concatenate(pairs), axis=0), np.concatenate(dense), sorted(asks)
            none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
            n = len(two), len(asks), len(rows)
            columns = [
                [pa.array(two[:, 0]), pa.array([x for x, _ in asks], pa.int64()), pa.array(ids[rows])],
                [pa.array(two[:, 1]), none(n[1]), none(n[2])],
                [none(n[0]), pa.array([x for _, x in asks], pa.int64()), pa.array(label[rows])],
                [none(n[0]), none(n[1]), pa.array(key[rows])],
                [none(n[0], pa.bool_()), none(n[1], pa.bool_()), pa.array(asked[rows].astype(bool))],
            ]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "left", "cell", "asked"])

    rows = with_halves(cells, classes).select("cell", "cid", "label", "asked", "size", "halves")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "cid")
    return map_batches(rows, compare, _PAIRED, rows=8192)


# --- confirmation on full sets


def full_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(cid, own): the whole sets of ``members`` (cid, id, h1, h2), from the texts of ``docs`` (doc_id, text).

    Texts are shuffled to their members; a filter of FILTER_BITS bits, whose size does not grow with
    the input, keeps most other texts where they are.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sets = [], []
            for cid, h1, h2, t in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingles(t, words)
                if set_name(own) == (h1, h2):  # else another row of the same doc_id
                    cids.append(cid)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "own"])

    def placed(df: DataFrame, id: str) -> DataFrame:
        at = df.withColumn("_h", F.pmod(F.xxhash64(id), F.lit(FILTER_BITS)))
        return at.withColumn("_w", F.shiftright("_h", 6)).withColumn("_bit", F.expr("shiftleft(1L, cast(_h & 63 as int))"))

    bits = placed(members, "id").groupBy("_w").agg(F.bit_or("_bit").alias("_bits"))  # FILTER_BITS / 64 rows at most
    some = placed(docs, "doc_id").join(F.broadcast(bits), "_w").where("_bits & _bit <> 0").select("doc_id", "text")
    # by shuffle at every size: what is moved then grows with the texts, and only members are held in memory
    texts = some.join(members.hint("shuffle_hash"), members["id"] == some["doc_id"]).select("cid", "h1", "h2", "text")
    return map_batches(texts, to_sets, "cid long, own binary").dropDuplicates(["cid"])


def sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cid, own): the whole sets of the classes ``ids`` (cid), each once."""
    members = stored(ids.distinct().join(classes.select("cid", "id", "h1", "h2"), "cid"), "members")
    return stored(full_sets(docs, members, words), "sets")


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("cid")).union(edges.select("b"))


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets (cid, own) have ``percent`` of their union in common. Two sets meet at a time."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    x, y = (sets.select(F.col("cid").alias(end), F.col("own").alias(f"own_{end}")).hint("merge") for end in ("a", "b"))
    both = edges.join(x, "a").join(y, "b").select("a", "b", "own_a", "own_b")
    return map_batches(both, check, "a long, b long", rows=64)


class Postings:
    """The sets of some rows by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many shingles each row has in common with a set."""
        lo, hi = (np.searchsorted(self.values, own, side=side) for side in ("left", "right"))
        many = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def links_of_sets(ids: np.ndarray, label: np.ndarray, asked: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) on full sets that join all labels of a cell which a link of an asked row joins: one less than labels at most."""
    index, group, links = Postings(sets), label.copy(), []
    for i in np.flatnonzero(asked).tolist():
        if (group == group[i]).all():
            continue
        common = index.common(sets[i])
        fine = 100 * common >= percent * (len(sets[i]) + index.sizes - common)
        for name in np.unique(group[fine & (group != group[i])]).tolist():
            links.append((int(ids[i]), int(ids[int((fine & (group == name)).argmax())])))
            group[group == name] = group[i]
    return links


def links_of_cells(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels of each cell of ``rows`` (cell, cid, label, asked); a set moves once a cell."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links() -> pa.RecordBatch:
            found = []
            if held:
                ids, label, asked = (np.array([r[k] for r in held]) for k in range(3))
                found = links_of_sets(ids, label, asked, [np.frombuffer(r[3], dtype=np.uint64) for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for c, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    yield links()
                    cell, held = c, []
                held.append(row)
        yield links()

    rows = rows.join(sets.hint("merge"), "cid").select("cell", "cid", "label", "asked", "own")
    return map_batches(rows.repartition("cell").sortWithinPartitions("cell", "cid"), compare, "a long, b long", rows=64)


def answered(asks: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b): of each ask (cid, label), one with a row of the label, if there is any, on full sets.

    The rows of a label are dealt into blocks of about REGION, its askers into lots of about ASKERS;
    each pair of a block and a lot is a task's work, however large label and lots are.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets, index = None, [], [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for c, asker, cid, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    cell, ids, sets, index = c, [], [], None
                own = np.frombuffer(raw, dtype=np.uint64)
                if not asker:
                    ids.append(cid)
                    sets.append(own)
                elif ids:
                    index = index or Postings(sets)
                    common = index.common(own)
                    fine = 100 * common >= percent * (len(own) + index.sizes - common)
                    if fine.any():
                        found.append((cid, ids[int(fine.argmax())]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    per = asks.groupBy("label").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("lots"))
    members = labels.withColumnRenamed("id", "cid").join(per, "label")
    blocks = members.groupBy("label").agg(F.ceil(F.count("*") / REGION).cast("int").alias("blocks"), F.first("lots").alias("lots"))

    def dealt(rows: DataFrame, asker: bool) -> DataFrame:
        rows = rows.select("cid", "label").join(blocks, "label")
        deal = lambda n: F.pmod(F.xxhash64("cid", F.lit(5)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block, lot = (every("blocks"), deal("lots")) if asker else (deal("blocks"), every("lots"))
        rows = rows.withColumn("block", block).withColumn("lot", lot)
        return rows.select(F.xxhash64("label", "block", "lot").alias("cell"), F.lit(asker).alias("asker"), "cid")

    rows = stored(dealt(members, False).unionByName(dealt(asks, True)), "cells")
    sets = sets_of(rows.select("cid"), classes, docs, words)
    rows = rows.join(sets.hint("merge"), "cid").select("cell", "asker", "cid", "own").repartition("cell")
    return map_batches(rows.sortWithinPartitions("cell", "asker"), answer, "a long, b long", rows=64)


def linked_labels(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, label) for every class that is linked with another; label is the smallest cid of its component."""

    def joined(links: DataFrame) -> DataFrame:
        links = stored(links, "links")
        if links.isEmpty():
            return labels
        return components(links.unionByName(labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))))

    company = stored(companies(classes, *LEVELS[0]), "company")
    found = edges_of_regions(company, classes, percent)
    if not company.where(F.col("rows") > REGION).isEmpty():
        found = found.unionByName(edges_of_runs(company, classes, percent))
    found = stored(found, "first")
    tried = stored(found.where("b is not null").select("a", "b").distinct(), "edges")
    labels = components(confirmed(tried, sets_of(ends_of(tried), classes, docs, words), percent))
    again = found.where("left is not null").select(F.col("left").alias("key")).distinct()
    left = company.join(again, "key", "left_semi").unionByName(company.where(F.col("rows") > REGION))
    for k in range(len(LEVELS)):
        last = k == len(LEVELS) - 1
        mixed = stored(mixed_regions(left, labels), "mixed")
        if mixed.isEmpty():
            return labels
        found = stored(pairs_of_cells(cells(mixed, last), classes, percent), "pairs")
        new = found.where("b is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        new = stored(new, "edges")
        dense = found.where("cell is not null").select("cell", F.col("a").alias("cid"), F.col("left").alias("label"), "asked")
        if not (new.isEmpty() and dense.isEmpty()):  # the sets of both move together, and their links are joined together
            sets = sets_of(ends_of(new).union(dense.select("cid")), classes, docs, words)
            labels = joined(confirmed(new, sets, percent).unionByName(links_of_cells(dense, sets, percent)))
            tried = tried.unionByName(new)
        now = labels.select(F.col("id").alias("cid"), F.col("label").alias("own"))
        asks = found.where("b is null and cell is null").select(F.col("a").alias("cid"), F.col("left").alias("was")).distinct().join(now, "cid", "left")
        asks = asks.join(labels.withColumnRenamed("id", "was"), "was", "left").select("cid", "own", F.coalesce("label", "was").alias("label"))
        asks = stored(asks.where(~F.col("own").eqNullSafe(F.col("label"))).select("cid", "label").distinct(), "asks")
        if not asks.isEmpty():
            labels = joined(answered(asks, labels, classes, docs, words, percent))
        crowd = mixed.where(crowded()).select("cid").distinct()
        if last or crowd.isEmpty():
            return labels
        # also rows of the main label go on: a crowded region goes on whole
        left = stored(companies(classes.join(crowd, "cid", "left_semi"), *LEVELS[k + 1]), "company")
    return labels


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
    with_hash: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept, for every row.

    ``with_hash`` adds text_hash, the xxhash64 of the text, which tells rows of one doc_id apart.

    Two rows are linked if their shingle sets have at least ``percent`` per cent of their union in
    common; the orders are made for 80 or more. A NULL or wordless text has an empty set and is
    linked with nothing. Repeated rows come back as often as they are there; rows of one doc_id with
    different texts are rows of their own, each in the component of its text. Rows with a NULL id are
    linked with nothing: their component_id is NULL and they are kept. Ties do not arise: links do not
    depend on an order. Very long texts are read whole, as one set in memory (two in a comparison). An
    empty table gives no rows. Only doc_id (an integer) and text are read, so other columns cannot clash.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signed_documents(src, words, "doc_id", "text"), "signed")
    usable = signed.where("h1 is not null and doc_id is not null")
    classes = usable.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.min("sig").alias("sig")
    )
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = linked_labels(classes, src, words, percent)
    named = classes.select("cid", "h1", "h2", "id").join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    component = named.join(least, "label", "left").select("h1", "h2", F.coalesce("least", "id").alias("component_id"))
    names = ["doc_id", *(["text_hash"] if with_hash else []), "n_shingles"]
    full = usable.join(component, ["h1", "h2"]).select(*names, "component_id")
    rest = signed.where("h1 is null or doc_id is null").select(*names, F.col("doc_id").alias("component_id"))
    return full.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
