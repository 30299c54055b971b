"""Writes as pure functions from (committed log, incoming rows) to the versions to append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import content_key, newest
from ..ordering import SMALL_ROWS, number_rows, with_previous
from ..session import materialise
from .snapshot import latest, watermark

_ROW = "__row"


def incoming_rows(incoming: DataFrame) -> DataFrame:
    """Incoming rows with no null flags or maps, their content key and a row number, written out once.

    Everything that compares or orders them afterwards works on the narrow columns; the
    payload is joined back by the row number at the end. Rows with a null dataset or id
    are no entities and are left out.
    """
    rows = incoming.where("dataset IS NOT NULL AND entity_id IS NOT NULL").select(
        "dataset", "entity_id", "pos", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("props", F.lit("{}")).alias("props"), F.coalesce("refs", F.lit("{}")).alias("refs")
    )
    return materialise(content_key(rows).withColumn(_ROW, F.monotonically_increasing_id()), "incoming")


def real_changes(log: DataFrame, rows: DataFrame, strict: bool = False, at_most: int | None = None) -> DataFrame:
    """``(dataset, entity_id, pos, __row)`` of those :func:`incoming_rows` that are real changes.

    A ``log`` that has its versions' ``content_key`` is read without their payload.
    ``at_most`` is the number of ``rows``, if counted.
    """
    narrow = rows.select("dataset", "entity_id", "pos", "content_key", _ROW)
    chained = with_previous(narrow, ["dataset", "entity_id"], ["pos", _ROW], "content_key", "batch_key", stored=True, at_most=at_most)
    # only versions of entities in the batch are compared, so only they are reduced and keyed
    touched = log.join(rows.select("dataset", "entity_id").distinct(), ["dataset", "entity_id"], "left_semi")
    committed = newest(touched, payload=("content_key",)) if "content_key" in log.columns else content_key(newest(touched))
    both = chained.join(committed.select("dataset", "entity_id", F.col("content_key").alias("old_key")), ["dataset", "entity_id"], "left")
    differs = F.col("content_key") != F.col("old_key")
    follows = F.col("batch_key").isNotNull()
    changed = F.col("content_key") != F.col("batch_key")
    keep = F.when(follows, changed).otherwise(F.col("old_key").isNull() | differs) if strict else F.col("old_key").isNull() | differs | (follows & changed)
    return both.where(keep).select("dataset", "entity_id", "pos", _ROW)


def new_versions(log: DataFrame, incoming: DataFrame, strict: bool = False) -> DataFrame:
    """The incoming rows ``(dataset, entity_id, pos, deleted, props, refs)`` that are real changes, with their ``content_key``.

    A row is kept if its entity has no committed version in the dataset, or differs from
    it, or differs from the row before it in the same batch. ``strict`` compares only with
    the version before it, so repeats inside a batch are dropped too. ``pos`` is the order
    of arrival. Rows with a null dataset or id are no entities and are left out.
    """
    rows = incoming_rows(incoming)
    return rows.join(real_changes(log, rows, strict, rows.count()).select(_ROW), _ROW, "left_semi").drop(_ROW)


def numbered(log: DataFrame, rows: DataFrame, strict: bool = False, n: int | None = None) -> DataFrame:
    """``(dataset, entity_id, __row, nth)``: the real changes with their place, from 0, among those of their dataset; ``n`` is the number of rows, if counted."""
    n = rows.count() if n is None else n
    kept = real_changes(log, rows, strict, n)
    kept = kept if n <= SMALL_ROWS else materialise(kept, "kept")
    return number_rows(kept, "dataset", ["pos", "entity_id", _ROW], "nth", stored=True, at_most=n).select("dataset", "entity_id", _ROW, "nth")


def stamped(rows: DataFrame, places: DataFrame, ends: DataFrame, recorded: int) -> DataFrame:
    """The versions of ``places`` with offsets from ``ends`` (dataset, next_offset) on; ``rows`` gives the payload."""
    numbers = places.join(ends, "dataset", "left").select(_ROW, (F.coalesce("next_offset", F.lit(0)) + F.col("nth")).alias("seq"), F.col("nth").alias("batch_seq"))
    return rows.join(numbers, _ROW).select("dataset", "seq", "entity_id", F.lit(recorded).cast("bigint").alias("recorded"), "batch_seq", "deleted", "props", "refs", "content_key")


def append(log: DataFrame, incoming: DataFrame, recorded: int, strict: bool = False) -> DataFrame:
    """The versions to append for one transaction over any number of datasets.

    All get the same ``recorded``; offsets go on without gaps where each dataset's log
    ends; ``batch_seq`` is the version's place in the batch, so a later row is newer.
    """
    rows = incoming_rows(incoming)
    return stamped(rows, numbered(log, rows, strict), watermark(log), recorded).drop("content_key")


def full_sync_deletions(log: DataFrame, seen: DataFrame, dataset: str) -> DataFrame:
    """Tombstones ``(dataset, entity_id, pos, deleted, props, refs)`` for live entities a full sync did not deliver."""
    return unseen(log.where(F.col("dataset") == dataset), seen.select(F.lit(dataset).alias("dataset"), "entity_id"))


def unseen(log: DataFrame, seen: DataFrame) -> DataFrame:
    """:func:`full_sync_deletions` of every dataset in ``log`` at once; ``seen`` is (dataset, entity_id)."""
    live = latest(log, include_deleted=False)
    gone = live.join(seen.select("dataset", "entity_id").distinct(), ["dataset", "entity_id"], "left_anti")
    return gone.select("dataset", "entity_id", F.lit(2**62).cast("bigint").alias("pos"), F.lit(True).alias("deleted"), "props", "refs")
