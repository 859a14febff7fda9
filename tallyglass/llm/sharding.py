"""Sharding over fixed virtual slots.

Records hash into thousands of slots; bytes are summed per slot; a versioned slot-to-shard map says
which shard a slot belongs to, and rebalancing edits that map instead of rehashing records.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm.common import own_dir, stored

N_SHARDS = 16
#: Slots are a parameter of the deployment, not of the data; the map and all that is per slot stay this small.
N_SLOTS = 4096
#: Rows alike that one task writes out.
BLOCK_ROWS = 100_000


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot. ``moves`` lists (slot, from, to) of the edit that made this version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    moves: tuple[tuple[int, int, int], ...] = ()

    @classmethod
    def initial(cls, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> SlotMap:
        """Version 1: slots dealt out in turn."""
        return cls(1, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def rebalanced(self, weights: np.ndarray, slack: float = 0.0) -> SlotMap:
        """The next version: slots move, or swap, from the heaviest to the lightest shard while that evens them.

        It is left as it is where the heaviest and the lightest differ by at most ``slack`` of a mean
        shard. The search ends after four edits a slot; only evenness suffers if that is too few.
        """
        shard = np.array(self.shards)
        w = np.asarray(weights, dtype=np.int64)
        load = np.bincount(shard, weights=w, minlength=self.n_shards).astype(np.int64)
        for _ in range(4 * len(shard)):
            hi, lo = int(load.argmax()), int(load.argmin())
            gap = int(load[hi] - load[lo])
            if gap <= max(1, slack * load.sum() / self.n_shards):
                break
            own = np.flatnonzero((shard == hi) & (w > 0) & (w < gap))
            give, best = None, gap
            if len(own):
                k = own[np.abs(2 * w[own] - gap).argmin()]
                give, best = (int(k), None), abs(gap - 2 * int(w[k]))
            theirs = np.flatnonzero((shard == lo) & (w > 0))
            theirs = theirs[np.argsort(w[theirs], kind="stable")]
            mine = np.flatnonzero((shard == hi) & (w > 0))
            if len(theirs) and len(mine):
                at = np.clip(np.searchsorted(w[theirs], w[mine] - gap / 2), 0, len(theirs) - 1)
                for shift in (0, -1):
                    other = theirs[np.clip(at + shift, 0, len(theirs) - 1)]
                    left = np.abs(gap - 2 * (w[mine] - w[other]))
                    left[w[mine] <= w[other]] = gap
                    i = int(left.argmin())
                    if left[i] < best:
                        give, best = (int(mine[i]), int(other[i])), int(left[i])
            if give is None or best >= gap:
                break
            for k, to, away in ((give[0], lo, hi), (give[1], hi, lo)):
                if k is not None:
                    shard[k] = to
                    load[to] += w[k]
                    load[away] -= w[k]
        return self._edited(shard, self.n_shards)

    def grown(self, weights: np.ndarray) -> SlotMap:
        """The next version with one more shard; slots move into the new shard only, from the heaviest ones."""
        shard, w, new = np.array(self.shards), np.asarray(weights, dtype=np.int64), self.n_shards
        load = np.bincount(shard, weights=w, minlength=new + 1).astype(np.int64)
        share = load.sum() / (new + 1)
        for hi in np.argsort(-load[:new], kind="stable"):
            for k in sorted(np.flatnonzero(shard == hi), key=lambda k: (-w[k], k)):
                if w[k] and load[hi] - w[k] >= share and load[new] + w[k] <= share:
                    shard[k], load[hi], load[new] = new, load[hi] - w[k], load[new] + w[k]
        return self._edited(shard, new + 1)

    def _edited(self, shard: np.ndarray, n_shards: int) -> SlotMap:
        moves = tuple((i, a, int(b)) for i, (a, b) in enumerate(zip(self.shards, shard)) if a != b)
        return SlotMap(self.version + 1, n_shards, tuple(int(x) for x in shard), moves)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.n_shards, i, s) for i, s in enumerate(self.shards)]
        return spark.createDataFrame(rows, "n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map table at ``path``; earlier versions stay readable.

        A version is claimed first, by a file that only one writer can create, so of two runs that
        edit the same version one is refused with a RuntimeError. A run that dies between its claim
        and its table leaves the claim behind; delete that file to save the version again.
        """
        claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{self.version}")
        files = claim.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(claim.getParent())
        try:
            claimed = files.createNewFile(claim)
        except Exception as error:  # some file systems raise where others return false
            raise RuntimeError(f"version {self.version} of {path} could not be claimed") from error
        if not claimed:
            raise RuntimeError(f"version {self.version} of {path} is saved or being saved by another run")
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version={self.version}")

    @classmethod
    def versions(cls, spark: SparkSession, path: str) -> list[int]:
        """Versions whose tables are complete, ascending."""
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("version=")]
        done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    @classmethod
    def table(cls, spark: SparkSession, path: str, version: int) -> DataFrame:
        """(n_shards, virtual_slot, shard) of a stored version: one row a slot."""
        return spark.read.schema("n_shards int, virtual_slot int, shard int").parquet(f"{path}/version={version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default."""
        version = cls.versions(spark, path)[-1] if version is None else version
        rows = cls.table(spark, path, version).orderBy("virtual_slot").collect()  # one per slot
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def to_slots(docs: DataFrame, n_slots: int = N_SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; NULL text: 1), text_crc32 (NULL text: of no bytes), virtual_slot.

    A slot is a hash of id and checksum; of rows that are alike in id, checksum and size the first keeps that
    slot, and the others take hashes of their number besides, so repeated rows (copies without an id
    above all) spread over all slots. Such rows are counted and then written out again, in blocks.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    alike = out.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    blocks = alike.where(F.col("_n") > BLOCK_ROWS).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK_ROWS))))
    many = blocks.repartition("doc_id", "text_crc32", "_b")  # a row that repeats without end is written out by many tasks
    every = alike.where(F.col("_n") <= BLOCK_ROWS).withColumn("_b", F.lit(0).cast("long")).unionByName(many)
    first = F.col("_b") * BLOCK_ROWS
    every = every.withColumn("_k", F.explode(F.sequence(first, F.least(first + BLOCK_ROWS, F.col("_n")) - 1)))
    own, more = F.xxhash64("doc_id", "text_crc32"), F.xxhash64("doc_id", "text_crc32", "_k")
    slot = F.pmod(F.when(F.col("_k") == 0, own).otherwise(more), F.lit(n_slots)).cast("int")
    return every.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_totals(slots: DataFrame, n_slots: int = N_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot: at most ``n_slots`` rows reach the driver, whatever the input."""
    size, rows = np.zeros(n_slots, dtype=np.int64), np.zeros(n_slots, dtype=np.int64)
    for r in slots.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def shard_documents(
    docs: DataFrame, map_path: str | None = None, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, slack: float = 0.0
) -> DataFrame:
    """Every row with its shard (law ``bytes``) and its gapless place ``slot`` in that shard.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (NULL: law ``key`` only),
    virtual_slot and map_version. The newest map at ``map_path`` is loaded (where there is none, an
    even one is stored as version 1; without a path, in the shared folder), edited for the bytes of
    these documents, stored as the next version if the edit moved a slot, and joined to the rows. Its
    numbers of shards and slots hold for the rows; a path is for one set of documents as it grows.

    NULL ids and texts are placed like others (size 1 for NULL text); repeated rows spread over
    the virtual slots and take places of their own; rows that tie in id, checksum and size are alike in all that is
    returned but the place. Very long texts stay in their task, only their size and checksum move. An
    empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    path = map_path or f"{own_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    if not SlotMap.versions(spark, path):
        SlotMap.initial(n_slots, n_shards).save(spark, path)
    m = SlotMap.load(spark, path)
    n_slots = len(m.shards)
    slots = stored(to_slots(docs, n_slots), "slots")
    size, rows = slot_totals(slots, n_slots)
    edited = m.rebalanced(size, slack)
    if edited.moves:
        edited.save(spark, path)
        m = edited
    first, seen = [0] * n_slots, [0] * m.n_shards
    for k, s in enumerate(m.shards):
        first[k], seen[s] = seen[s], seen[s] + int(rows[k])
    table = SlotMap.table(spark, path, m.version).join(
        spark.createDataFrame(list(enumerate(first)), "virtual_slot int, first long"), "virtual_slot"
    )
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        slots.withColumn("place", place)
        .join(F.broadcast(table.select("virtual_slot", "shard", "first")), "virtual_slot")  # n_slots rows by construction
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(m.version).alias("map_version"),
        )
    )
