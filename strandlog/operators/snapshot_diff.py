"""What changed between consecutive full snapshots, by bitmaps over persistent ordinals."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..identity import Namespaces
from ..jsoncanon import canonical_content
from ..session import materialise
from ..shared import SharedFiles

#: Ordinals of one container: its bitmap takes at most a bit each, its vector 16 bytes for each present one.
CONTAINER = 1 << 14

_ORDINALS = "dataset string, id string, shard int, ordinal bigint"
_MARK = 16  # bytes of a content mark


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        props, refs = batch.column("props").to_pylist(), batch.column("refs").to_pylist()
        marks = [hashlib.blake2b(canonical_content(p, r), digest_size=_MARK).digest() for p, r in zip(props, refs)]
        keep = [batch.column(c) for c in ("dataset", "snapshot_no", "id", "delivered_at")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(marks, pa.binary())], ["dataset", "snapshot_no", "id", "delivered_at", "mark"])


def fingerprints(snapshots: DataFrame, namespaces: Namespaces) -> DataFrame:
    """``(dataset, snapshot_no, id, mark)``: one 128-bit content mark per delivered record.

    Records repeated within a delivery: the last delivered one counts, on a tie the
    greatest mark. Rows with a null dataset, snapshot_no or id are no records.
    """
    rows = snapshots.where("dataset IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL")
    rows = namespaces.compress(rows.select("dataset", "snapshot_no", "id", F.col("delivered_at").cast("timestamp_ntz").alias("delivered_at"), "props", "refs"), "id")
    marked = rows.mapInArrow(_fingerprint, "dataset string, snapshot_no int, id string, delivered_at timestamp_ntz, mark binary")
    return marked.groupBy("dataset", "id", "snapshot_no").agg(F.max(F.struct("delivered_at", "mark")).alias("m")).select("dataset", "snapshot_no", "id", "m.mark")


def new_ordinals(keys: DataFrame, known: DataFrame | None = None, container: int = CONTAINER) -> DataFrame:
    """``(dataset, id, shard, ordinal)`` of the distinct keys that ``known`` lacks.

    A dataset's new keys fill its last shard while that holds at most a container;
    more of them get new shards, as many as they fill by a hash of the key. So a shard is
    about one container, however much a dataset grows after it was first seen, and is
    numbered by itself. An ordinal, once given, never changes.
    """
    distinct = keys.select("dataset", "id").distinct()
    if known is not None:
        distinct = distinct.join(known.select("dataset", "id"), ["dataset", "id"], "left_anti")
    fresh = distinct.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    if known is not None:
        tops = known.groupBy("dataset", "shard").agg((F.max("ordinal") + 1).alias("held"))
        fresh = fresh.join(tops.groupBy("dataset").agg(F.max(F.struct("shard", "held")).alias("top")), "dataset", "left")
    else:
        fresh = fresh.withColumn("top", F.lit(None).cast("struct<shard:int,held:bigint>"))
    fits = F.coalesce(F.col("top.held") + F.col("n") <= container, F.lit(False))
    begin = F.when(fits, F.col("top.shard")).otherwise(F.coalesce(F.col("top.shard") + 1, F.lit(0)))
    shards = fresh.select("dataset", begin.alias("first"), F.when(fits, F.lit(1)).otherwise(F.ceil(F.col("n") / container)).cast("int").alias("shards"), F.when(fits, F.col("top.held")).otherwise(F.lit(0)).alias("base"))
    placed = distinct.join(shards, "dataset").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id"), "shards")).cast("int"))
    nth = F.row_number().over(Window.partitionBy("dataset", "shard").orderBy("id")) - 1
    return placed.select("dataset", "id", "shard", (F.col("base") + nth).cast("bigint").alias("ordinal"))


def assign_ordinals(keys: DataFrame, known: DataFrame | None = None, container: int = CONTAINER) -> DataFrame:
    """``(dataset, id, shard, ordinal)`` for every distinct key, keeping the ordinals in ``known``; see :func:`new_ordinals`."""
    fresh = new_ordinals(keys, known, container)
    return fresh if known is None else known.select("dataset", "id", "shard", "ordinal").unionByName(fresh)


class OrdinalIndex:
    """The ordinals of all keys seen so far, kept in ``folder`` on shared storage.

    Every extension writes the new keys as a part of its own and then names it in one
    step, so an extension that failed leaves nothing behind that is read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = SharedFiles(folder, spark)

    def ordinals(self) -> DataFrame | None:
        """``(dataset, id, shard, ordinal)`` of the keys seen, None if there are none yet."""
        parts = (self._files.get("index") or {"parts": []})["parts"]
        return self.spark.read.schema(_ORDINALS).parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else None

    def extend(self, keys: DataFrame, container: int = CONTAINER) -> DataFrame:
        """Gives the keys that are new their ordinals and returns those of all keys."""
        held = self._files.get("index") or {"parts": [], "container": container}
        if held["container"] != container:
            raise ValueError(f"the index was made with containers of {held['container']}")
        part = f"part-{uuid.uuid4().hex}"
        new_ordinals(keys, self.ordinals(), container).write.option("compression", "zstd").parquet(f"{self.folder}/{part}")
        if not held["parts"] or not self.spark.read.schema(_ORDINALS).parquet(f"{self.folder}/{part}").isEmpty():
            self._files.put("index", {**held, "parts": [*held["parts"], part]})
        return self.ordinals()


def compress(slots: np.ndarray, container: int) -> bytes:
    """A set of sorted slots as a compressed bitmap: two bytes a slot if that is shorter, else one bit a place."""
    if len(slots) * 16 < container:
        return b"A" + slots.astype("<u2").tobytes()
    present = np.zeros(container, dtype=bool)
    present[slots] = True
    return b"B" + np.packbits(present).tobytes()


def words(bitmap: bytes | None, container: int) -> np.ndarray:
    """The bits of a compressed bitmap, eight to a byte; no bitmap is the empty set."""
    if bitmap is None:
        return np.zeros(-(-container // 8), dtype=np.uint8)
    if bitmap[:1] == b"B":
        return np.frombuffer(bitmap, np.uint8, offset=1)
    present = np.zeros(container, dtype=bool)
    present[np.frombuffer(bitmap, "<u2", offset=1)] = True
    return np.packbits(present)


def _slots(bits: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(bits))[0]


def _pack(batches: Iterator[pa.RecordBatch], container: int) -> Iterator[pa.RecordBatch]:
    """Rows (one snapshot's slots and marks of a container) to bitmap and aligned vector."""
    for batch in batches:
        bitmaps, vectors = [], []
        for slots, marks in zip(batch.column("slots"), batch.column("marks")):
            at = np.asarray(slots.values, dtype=np.int64)
            order = np.argsort(at)
            bitmaps.append(compress(at[order], container))
            m = marks.values.to_pylist()
            vectors.append(b"".join(m[i] for i in order))
        keep = [batch.column(c) for c in ("dataset", "shard", "container", "snapshot_no")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(bitmaps, pa.binary()), pa.array(vectors, pa.binary())], ["dataset", "shard", "container", "snapshot_no", "bitmap", "vector"])


_KINDS = ("added", "removed", "changed")


def _compare(batches: Iterator[pa.RecordBatch], container: int) -> Iterator[pa.RecordBatch]:
    """Two packed containers per row to the slots added, removed and changed."""
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        rows, slots, kinds = [], [], []
        for i in range(batch.num_rows):
            was, now = words(cols["old_bitmap"][i], container), words(cols["new_bitmap"][i], container)
            both = _slots(was & now)
            # a slot's rank among the present ones is its place in the vector
            old, new = (np.frombuffer(cols[f"{side}_vector"][i] or b"", dtype=f"V{_MARK}") for side in ("old", "new"))
            a, b = (vector[np.searchsorted(_slots(bits), both)] for vector, bits in ((old, was), (new, now)))
            for kind, hit in zip(_KINDS, (_slots(now & ~was), _slots(was & ~now), both[a != b])):
                rows += [i] * len(hit)
                slots += hit.tolist()
                kinds += [kind] * len(hit)
        take = pa.array(rows, pa.int64())
        keep = [batch.column(c).take(take) for c in ("dataset", "shard", "container", "snapshot_no")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(slots, pa.int32()), pa.array(kinds, pa.string())], ["dataset", "shard", "container", "snapshot_no", "slot", "change_kind"])


def snapshot_changes(snapshots: DataFrame, namespaces: Namespaces, index: OrdinalIndex | None = None, container: int = CONTAINER) -> DataFrame:
    """``(dataset, snapshot_no, id, change_kind)`` against the next lower snapshot the dataset has.

    Keys get persistent ordinals (those of ``index``, which is extended; without one they
    last for this call); each snapshot
    becomes, per container of ordinals, a compressed bitmap of the keys present and a vector of
    content marks in ordinal order. Bitmap AND-NOT gives additions and removals, the
    common bits select the marks to compare. One task holds two containers at a time.

    Snapshots are ordered by number, not by delivery; missing numbers are skipped. A
    dataset's first snapshot changes nothing; a container absent from a snapshot counts
    as empty. Null props or refs mean ``{}``; text that is no JSON compares as written.
    """
    marks = materialise(fingerprints(snapshots, namespaces), "marks")
    ordinals = index.extend(marks, container) if index is not None else materialise(assign_ordinals(marks, None, container), "ordinals")
    numbered = marks.join(ordinals, ["dataset", "id"])
    numbered = numbered.select("dataset", "shard", F.floor(F.col("ordinal") / container).cast("int").alias("container"), "snapshot_no", F.pmod(F.col("ordinal"), F.lit(container)).cast("int").alias("slot"), "mark")
    listed = numbered.groupBy("dataset", "shard", "container", "snapshot_no").agg(F.collect_list(F.struct("slot", "mark")).alias("l"))
    packed = listed.select("dataset", "shard", "container", "snapshot_no", F.col("l.slot").alias("slots"), F.col("l.mark").alias("marks")).mapInArrow(
        lambda it: _pack(it, container), "dataset string, shard int, container int, snapshot_no int, bitmap binary, vector binary"
    )
    packed = materialise(packed, "containers")
    numbers = marks.groupBy("dataset", "snapshot_no").agg(F.lit(1).alias("x"))
    follows = numbers.select("dataset", "snapshot_no", F.lead("snapshot_no").over(Window.partitionBy("dataset").orderBy("snapshot_no")).alias("next_no"), F.lag("snapshot_no").over(Window.partitionBy("dataset").orderBy("snapshot_no")).alias("prev_no"))
    both = packed.join(follows, ["dataset", "snapshot_no"])
    box = lambda role: F.when(role, F.struct("bitmap", "vector"))
    # each container serves its own snapshot as the new side and the next snapshot as the old side
    roles = both.withColumn("role", F.explode(F.array(F.struct(F.when(F.col("prev_no").isNotNull(), F.col("snapshot_no")).alias("at"), F.lit(True).alias("new")), F.struct(F.col("next_no").alias("at"), F.lit(False).alias("new"))))).where("role.at IS NOT NULL")
    pairs = roles.groupBy("dataset", "shard", "container", F.col("role.at").alias("snapshot_no")).agg(F.max(box(~F.col("role.new"))).alias("old"), F.max(box(F.col("role.new"))).alias("new"))
    pairs = pairs.select("dataset", "shard", "container", "snapshot_no", F.col("old.bitmap").alias("old_bitmap"), F.col("old.vector").alias("old_vector"), F.col("new.bitmap").alias("new_bitmap"), F.col("new.vector").alias("new_vector"))
    slots = pairs.mapInArrow(lambda it: _compare(it, container), "dataset string, shard int, container int, snapshot_no int, slot int, change_kind string")
    found = slots.withColumn("ordinal", F.col("container").cast("bigint") * container + F.col("slot"))
    return found.join(ordinals, ["dataset", "shard", "ordinal"]).select("dataset", "snapshot_no", "id", "change_kind")
