"""Snapshots, change feeds and paging over the change log."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import newest


def as_of(changes: DataFrame, at: int) -> DataFrame:
    """Versions recorded not later than ``at`` (nanoseconds); the filter reaches the scan."""
    return changes.where(F.col("recorded") <= at)


def in_scope(changes: DataFrame, catalog: DataFrame | None = None, datasets: list[str] | None = None) -> DataFrame:
    """Versions of the datasets asked for.

    Names unknown to the catalog are dropped; an empty list, or one of unknown names
    only, restricts nothing. With a catalog, versions of deleted datasets are never visible.
    """
    if catalog is not None:
        gone = catalog.where("deleted").select("dataset")
        changes = changes.join(gone, "dataset", "left_anti")
    if datasets:
        known = datasets
        if catalog is not None:
            known = [r.dataset for r in catalog.where(F.col("dataset").isin(datasets)).select("dataset").distinct().collect()]
        if known:
            changes = changes.where(F.col("dataset").isin(known))
    return changes


def latest(changes: DataFrame, at: int | None = None, include_deleted: bool = True, payload: tuple[str, ...] = ("props", "refs")) -> DataFrame:
    """Newest version per (dataset, entity), tombstones included unless told otherwise.

    Only the ``payload`` columns asked for are read and shuffled.
    """
    found = newest(as_of(changes, at) if at is not None else changes, payload=("deleted", *payload))
    return found if include_deleted else found.where("NOT deleted")


def latest_only(changes: DataFrame) -> DataFrame:
    """Changes that are their entity's newest version in the dataset.

    A join of the feed with the reduced (dataset, entity) -> newest place, not a window:
    the reduction happens before the shuffle, so an entity with very many versions is no
    single task.
    """
    top = changes.groupBy("dataset", "entity_id").agg(F.max(F.struct("recorded", "batch_seq", "seq")).alias("top")).select("dataset", F.col("top.seq").alias("seq"))
    return changes.join(top, ["dataset", "seq"], "left_semi")


def feed(changes: DataFrame, dataset: str, since: int = 0, limit: int | None = None, only_latest: bool = False, reverse: bool = False) -> DataFrame:
    """The dataset's changes from offset ``since`` on (reverse: from it downwards, 0 = from the end).

    ``limit`` counts emitted rows; ``only_latest`` is judged over the whole dataset.
    """
    rows = changes.where(F.col("dataset") == dataset)
    if only_latest:
        rows = latest_only(rows)
    if reverse:
        rows = rows.where(F.col("seq") <= since) if since else rows
        rows = rows.orderBy(F.col("seq").desc())
    else:
        rows = rows.where(F.col("seq") >= since).orderBy("seq")
    return rows.limit(limit) if limit is not None and limit > 0 else rows


def watermark(changes: DataFrame) -> DataFrame:
    """``(dataset, next_offset)``: one past the last change of each dataset."""
    return changes.groupBy("dataset").agg((F.max("seq") + 1).alias("next_offset"))


def next_offset(page: DataFrame, since: int) -> int:
    """The token after a page: last visited offset + 1, unchanged if the page is empty."""
    last = page.agg(F.max("seq")).first()[0]
    return since if last is None else last + 1


def next_offsets(rows: DataFrame, since: dict[str, int]) -> dict[str, int]:
    """:func:`next_offset` of several datasets' rows in one pass."""
    last = {r.dataset: r["last"] for r in rows.groupBy("dataset").agg(F.max("seq").alias("last")).collect()}
    return {d: last[d] + 1 if d in last else n for d, n in since.items()}


def entity_page(entities: DataFrame, after: str | None = None, count: int = 0, key: str = "entity_id") -> DataFrame:
    """Entities in order of id after the last one seen; a count of 0 or below means all."""
    rows = entities if after is None else entities.where(F.col(key) > after)
    rows = rows.orderBy(key)
    return rows.limit(count) if count > 0 else rows


def encode_token(value: int | str | dict) -> str:
    """A continuation token: base64 of decimal text, key text or JSON."""
    text = json.dumps(value, sort_keys=True) if isinstance(value, dict) else str(value)
    return base64.b64encode(text.encode()).decode()


def decode_token(token: str | None) -> str:
    """The text of a token; empty and null tokens are the start."""
    return base64.b64decode(token, validate=True).decode() if token else ""


def version_flags(changes: DataFrame) -> DataFrame:
    """``(dataset, entity_id, seq, is_first, is_last)``: whether a version is its entity's first or last in the dataset.

    First and last are reduced per entity and joined, so no entity's history is one task.
    """
    order = F.struct("recorded", "batch_seq", "seq")
    ends = changes.groupBy("dataset", "entity_id").agg(F.min(order).alias("a"), F.max(order).alias("z"))
    both = changes.select("dataset", "entity_id", "seq").join(ends, ["dataset", "entity_id"])
    return both.select("dataset", "entity_id", "seq", (F.col("seq") == F.col("a.seq")).alias("is_first"), (F.col("seq") == F.col("z.seq")).alias("is_last"))
