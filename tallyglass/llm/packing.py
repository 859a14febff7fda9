"""Best-fit packing by linear grouping.

Lengths are integers up to the sequence length, so how many pieces have each length is all that a
plan needs: at most 1024 numbers, whatever the corpus. On them the driver groups the large lengths
into groups of equal cardinality, rounds each group up to its longest, optimises configurations of
these few sizes by column generation, substitutes the actual lengths, and best-fits what is left
and the small lengths. The plan says for each length which ranks go to which sequences; pieces get
their rank within their length by a salted count.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm.bpe import VOCABULARY, byte_bpe
from tallyglass.llm.common import map_batches, stored

CAPACITY = 1024
END_ID = 2
#: Groups of the large lengths. A length is large if it is above CAPACITY / part; each part is tried and the
#: plan of the fewest sequences is taken: fewer large lengths round up less, more of them are optimised together.
#: On a tie the finer part is taken.
GROUPS, SMALL_PARTS = 128, (5, 3)
#: Pieces of one length that are ranked in one task, about; and the most salts.
RANKED_TOGETHER, MOST_SALTS = 500_000, 256


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole, or full pieces after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(i, capacity) for i in range(first, n, capacity)]


def pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; NULL text: the end id alone."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(vocabulary), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for key, t in zip(ids, batch.column(1).to_pylist()):
                raw = bpe.encode(t or "") + end
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (key, k, start, length, crc)):
                        column.append(value)
            types = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return map_batches(src, encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """Sequences that hold the same lengths in the same order."""

    count: int
    room: int
    held: list[int] = field(default_factory=list)


def grouped(counts: np.ndarray, large: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """Large lengths, longest first, in groups of equal cardinality: (rounded-up size, [[length, count], ...])."""
    todo = [[n, int(counts[n])] for n in range(len(counts) - 2, large - 1, -1) if counts[n]]
    if len(todo) <= groups:
        return [(n, [[n, c]]) for n, c in todo]
    share, out, room = -(-sum(c for _, c in todo) // groups), [], 0
    for n, c in todo:
        while c:
            if not room:
                out.append((n, []))
                room = share
            take = min(c, room)
            out[-1][1].append([n, take])
            c, room = c - take, room - take
    merged: list[tuple[int, list[list[int]]]] = []
    for size, own in out:
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(own)
        else:
            merged.append((size, own))
    return merged


def _best_pattern(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest value: an integer knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    after = [best]
    for s, v in zip(sizes, value):
        best = best.copy()
        if v > 1e-12:
            for k in range(1, capacity // s + 1):
                best[k * s :] = np.maximum(best[k * s :], after[-1][: capacity + 1 - k * s] + k * v)
        after.append(best)
    pattern, left = np.zeros(len(sizes)), capacity
    for i in range(len(sizes) - 1, -1, -1):
        k = 0
        while after[i + 1][left] > after[i][left] + 1e-12 and k <= left // sizes[i]:
            if abs(after[i][left - k * sizes[i]] + k * value[i] - after[i + 1][left]) < 1e-9 and k:
                break
            k += 1
        pattern[i], left = k, left - k * sizes[i]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, most_rounds: int = 1500) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations, rounded down from the linear optimum by column generation.

    It ends after ``most_rounds`` new configurations at the latest; only tightness suffers if that is too few.
    """
    m = len(sizes)
    if not m:
        return []
    # Products by sums, not by BLAS: its threads can hang in a process that has started a JVM.
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    wanted = np.array(demand, dtype=float)
    amount = (inverse * wanted).sum(axis=1)
    for _ in range(most_rounds):
        value = inverse.sum(axis=0)
        gain, pattern = _best_pattern(sizes, value, capacity)
        if gain <= 1 + 1e-7:
            break
        move = (inverse * pattern).sum(axis=1)
        ratios = np.where(move > 1e-10, amount / np.where(move > 1e-10, move, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = pattern
        pivot = inverse[out] / move[out]
        inverse -= move[:, None] * pivot[None, :]
        inverse[out] = pivot
        amount = np.maximum((inverse * wanted).sum(axis=1), 0)
    return [(int(x + 1e-6), basis[:, k].astype(int)) for k, x in enumerate(amount) if int(x + 1e-6)]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, parts: tuple = SMALL_PARTS) -> list[Bins]:
    """Bins for ``counts[n]`` pieces of length n; every piece is in exactly one."""
    return min((_plan(counts, capacity, groups, p) for p in parts), key=lambda bins: sum(b.count for b in bins))


def _plan(counts: np.ndarray, capacity: int, groups: int, small_part: int) -> list[Bins]:
    """The configurations with actual lengths in their slots, those of the longest sizes first, and best fit for the rest.

    A slot is given the longest length that is left of those up to its group's size; what rounding up
    has lost gathers in the last slot, which takes the longest large length that fits the real room.
    A slot for which nothing is left stays empty.
    """
    large = capacity // small_part + 1
    own = grouped(counts, large, groups)
    sizes = [s for s, _ in own]
    bins = [Bins(int(counts[capacity]), 0, [capacity])] if counts[capacity] else []
    left = np.array(counts, dtype=np.int64)
    left[capacity] = 0
    found = configurations(sizes, [sum(c for _, c in lengths) for _, lengths in own], capacity)
    for number, pattern in sorted(found, key=lambda c: (int(np.flatnonzero(c[1])[0]), *(-c[1]).tolist())):
        slots = [s for s, k in zip(sizes, pattern) for _ in range(k)]
        while number:
            heads: list[int] = []
            for k, size in enumerate(slots):
                n = min(size if k < len(slots) - 1 else capacity - sum(heads), capacity - 1)
                while n >= large and left[n] <= heads.count(n):
                    n -= 1
                if n >= large:
                    heads.append(n)
            if not heads:
                break
            run = min([number, *(int(left[n]) // heads.count(n) for n in heads)])
            bins.append(Bins(run, capacity - sum(heads), heads))
            for n in heads:
                left[n] -= run
            number -= run
    return best_fit(left, bins, capacity)


def best_fit(left: np.ndarray, bins: list[Bins], capacity: int) -> list[Bins]:
    """Put ``left[n]`` pieces of each length n, longest first, where the least room that fits is."""
    by_room: dict[int, list[Bins]] = {}
    for b in bins:
        by_room.setdefault(b.room, []).append(b)
    rooms = sorted(by_room)

    def file(b: Bins) -> None:
        if b.room not in by_room:
            by_room[b.room] = []
            bisect.insort(rooms, b.room)
        by_room[b.room].append(b)

    for n in range(len(left) - 1, 0, -1):
        todo = int(left[n])
        while todo:
            at = bisect.bisect_left(rooms, n)
            while at < len(rooms) and not by_room[rooms[at]]:
                del by_room[rooms[at]], rooms[at]
            b = by_room[rooms[at]].pop() if at < len(rooms) else Bins(-(-todo // (capacity // n)), capacity)
            each = b.room // n
            whole = min(b.count, todo // each)
            rest = min(todo - whole * each, each) if whole < b.count else 0
            if whole:
                file(Bins(whole, b.room - each * n, b.held + [n] * each))
            if rest:
                file(Bins(1, b.room - rest * n, b.held + [n] * rest))
            if (idle := b.count - whole - bool(rest)) and b.held:
                file(Bins(idle, b.room, b.held))
            todo -= whole * each + rest
    return [b for own in by_room.values() for b in own]


def runs(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) by length and rank: the plan as it is sent to tasks."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for b in bins:
        at = 0
        for n in b.held:
            out.append((n, rank.get(n, 0), sequence, at))
            rank[n], at = rank.get(n, 0) + b.count, at + n
        sequence += b.count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    NULL and empty texts are one piece of the end id; NULL ids and repeated rows are packed like any
    others, each on its own; pieces of one length are interchangeable, so ties do not matter; very
    long texts are encoded whole and cut; an empty table gives no rows. Only doc_id and text are read,
    so other columns cannot clash. To the driver go the counts by length and salt (at most
    ``capacity`` by ``MOST_SALTS`` rows), to the tasks the plan, whose size depends on ``capacity``
    alone. A piece of full length is a sequence of its own and is not ranked, however many there are.
    """
    spark = docs.sparkSession
    table = stored(pieces(docs, doc_id, text, capacity, vocabulary), "pieces")
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    part = table.where(F.col("length") < capacity)
    salts = min(MOST_SALTS, max(16, part.count() // RANKED_TOGETHER))
    part = part.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per_salt = part.groupBy("length", "salt").agg(F.count("*").alias("n"))
    found = sorted((r["length"], r["salt"], r["n"]) for r in per_salt.collect())
    counts, before = np.zeros(capacity + 1, dtype=np.int64), []
    for length, salt, n in found:
        before.append((length, salt, int(counts[length])))
        counts[length] += n
    bins = plan(counts, capacity)
    rows, planned = runs(bins), sum(b.count for b in bins)
    key = (rows[:, 0] << 40) + rows[:, 1]
    offsets = spark.createDataFrame(before, "length long, salt int, before long")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        part.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["length", "salt"])  # bounded as said above
        .select(*names, (F.col("before") + F.col("rank") - 1).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            made = (rows[at, 2] + rank - rows[at, 1], rows[at, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, made)], [*names, "sequence_id", "offset"])

    kind = dict(ranked.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    alone = (F.lit(planned) + F.monotonically_increasing_id()).alias("sequence_id")  # over a stored table: the same at each read
    full = table.where(F.col("length") == capacity).select(*names, alone, F.lit(0).cast("long").alias("offset"))
    return map_batches(ranked, place, schema).unionByName(full)
