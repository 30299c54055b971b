"""Current state from a change feed, resolved from the newest change backwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: After so many older batches the resolved keys are written out, so plans stay small.
_CHAIN = 4
_BATCH = "__batch"


def time_batches(feed: DataFrame, by: str, n: int) -> list[DataFrame]:
    """Cut ``feed`` into at most ``n`` batches by ``by``, newest first.

    Cuts are approximate quantiles, so batches are of similar size whatever the spread
    of ``by``; they take a pass over that column alone. One more pass writes the feed's
    rows by batch, without a shuffle, and every batch is then read from its own folder.
    Give only the columns needed. Rows with a null ``by`` belong to the oldest batch.
    """
    shares = [i / n for i in range(1, n)]
    cuts = feed.select(F.percentile_approx(by, shares, 1000)).first()[0] if shares else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [feed]
    at = reduce(lambda number, cut: number + F.when(F.col(by) >= cut, 1).otherwise(0), cuts, F.lit(0))
    placed = materialise(feed.withColumn(_BATCH, at), "batches", by=_BATCH)
    return [placed.where(F.col(_BATCH) == i).drop(_BATCH) for i in range(len(cuts), -1, -1)]


def newest_first(
    batches: list[DataFrame],
    base: DataFrame | None = None,
    *,
    keys: tuple[str, ...] = ("dataset", "id"),
    order: tuple[str, ...] = ("recorded", "batch_seq"),
    deleted: str = "deleted",
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """Rebuild the current rows from change batches given newest first.

    Every batch is reduced to the newest image of each key (combined on the map side, so
    a hot key travels once per task), then loses the keys that newer batches resolved by
    an anti join; what is left are first-seen images or tombstones. ``base`` holds the
    rows from before all batches and is appended where untouched. All sides are
    hash-partitioned by ``keys`` already, so the anti joins shuffle nothing again.

    Within a batch any order and any number of repeats is allowed: the greatest ``order``
    wins, then, on a full tie, a live version before a tombstone, then the greatest
    ``payload``. A null in ``order`` counts as oldest, null ``deleted`` as not deleted.
    Rows with a null key name no entity and are left out. Other input columns are ignored.
    Result: keys, order and payload columns of each live entity, once each.
    """

    def image(df: DataFrame) -> DataFrame:
        live = ~F.coalesce(F.col(deleted), F.lit(False))
        fields = [F.col(c).alias(c) for c in order] + [live.alias("live")] + [F.col(c).alias(c) for c in payload]
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        return df.where(known).groupBy(*keys).agg(F.max(F.struct(*fields)).alias("image"))

    images = [image(b) for b in [*batches, *([base] if base is not None else [])]]
    resolved: list[DataFrame] = []
    out: list[DataFrame] = []
    for i, df in enumerate(images):
        fresh = reduce(lambda left, right: left.join(right.select(*keys), list(keys), "left_anti"), resolved, df)
        out.append(fresh)
        resolved.append(df)
        if len(resolved) > _CHAIN and i + 1 < len(images):
            seen = reduce(DataFrame.unionByName, [r.select(*keys) for r in resolved])
            resolved = [materialise(seen.distinct(), "resolved")]
    rows = reduce(DataFrame.unionByName, out)
    return rows.where("image.live").select(*keys, *[F.col(f"image.{c}").alias(c) for c in (*order, *payload)])
