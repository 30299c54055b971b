"""References whose target does not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..identity import Namespaces
from ..model import ref_pairs
from ..session import materialise

#: An id with more events (versions plus references) than this, or than a ten-thousandth of all events, is cut into time slices.
HOT_EVENTS = 50_000
_SHARE = 10_000

PARENT, REFERENCE = 0, 1


def events_of(log: DataFrame, namespaces: Namespaces) -> DataFrame:
    """Versions (parents) and references of a change log in one stream of id events.

    A row gives one parent event under its own id and, if not deleted, one reference event
    under each id that it names. Copies of a row are reduced to one before its text is read.
    """
    rows = log.select(
        "dataset",
        "seq",
        "id",
        "recorded",
        F.coalesce("batch_seq", F.lit(-1)).alias("batch_seq"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        "refs",
    ).where("dataset IS NOT NULL AND recorded IS NOT NULL").distinct()
    nothing = F.lit(None).cast("string")
    own = F.array(F.struct(nothing.alias("predicate"), F.col("id").alias("target")))
    links = F.coalesce(F.when(~F.col("deleted") & F.col("seq").isNotNull(), ref_pairs(F.col("refs"))), F.array().cast("array<struct<predicate:string,target:string>>"))
    events = rows.select("dataset", "seq", "recorded", "batch_seq", "deleted", F.posexplode(F.concat(own, links)).alias("pos", "e")).select(
        "dataset",
        "seq",
        "recorded",
        "batch_seq",
        "deleted",
        F.when(F.col("pos") == 0, F.lit(PARENT)).otherwise(F.lit(REFERENCE)).alias("kind"),
        F.col("e.predicate").alias("predicate"),
        F.col("e.target").alias("id"),
    )
    return namespaces.compress(events.where("id IS NOT NULL"), "id", "predicate")


def _sliced(events: DataFrame, hot_events: int) -> DataFrame:
    """``events`` with a ``slice``: 0, but for hot ids a time slice, each begun by the carried-in state, and a ``salt``.

    The hot list is bounded (every entry stands for at least a ten-thousandth of all
    events), so it is broadcast. ``known`` tells whether a hot id has any version. A hot
    id's versions of one dataset and time are reduced to the newest, so an instant has at
    most as many as there are datasets; references of a slice that time cannot cut
    further are spread by a salt, each share beside all versions of the slice.
    """
    counts = events.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == PARENT, 1).otherwise(0)).alias("parents"))
    limit = max(hot_events, (events.count() + _SHARE - 1) // _SHARE)
    hot_ids = materialise(counts.where(F.col("n") > limit), "hot-counts")
    if hot_ids.isEmpty():
        return events.withColumns({"slice": F.lit(0), "salt": F.lit(0), "known": F.lit(None).cast("boolean")})
    parts = F.ceil(F.col("n") / limit).cast("int")
    names = F.broadcast(hot_ids.select("id", "parents", parts.alias("parts")))
    spread = events.select("id", "recorded").join(names, "id")
    # one row per hot id: percentiles at hundredths, of which every parts-th share is a cut
    hundredths = [i / 100 for i in range(1, 100)]
    cuts = (
        spread.groupBy("id", "parts", "parents")
        .agg(F.percentile_approx("recorded", hundredths, 10_000).alias("q"))
        .select("id", (F.col("parents") > 0).alias("known"), F.array_distinct(F.filter("q", lambda x, i: (i + 1) % F.greatest(F.lit(1), F.floor(F.lit(100) / F.col("parts")).cast("int")) == 0)).alias("cuts"))
    )
    cuts = materialise(cuts, "hot-ids")
    at = F.size(F.filter("cuts", lambda c: c <= F.col("recorded")))
    placed = events.join(F.broadcast(cuts), "id", "left")
    cold = placed.where("cuts IS NULL").withColumns({"slice": F.lit(0), "salt": F.lit(0)}).drop("cuts")
    hot = materialise(placed.where("cuts IS NOT NULL").withColumns({"slice": at, "last": F.size("cuts")}).drop("cuts"), "hot-events")
    order = F.struct("batch_seq", (~F.col("deleted")).alias("live"))
    versions = hot.where(F.col("kind") == PARENT).groupBy("id", "dataset", "slice", "last", "recorded").agg(F.max(order).alias("v")).select("id", "dataset", "slice", "last", "recorded", "v.batch_seq", (~F.col("v.live")).alias("deleted"))
    # state carried into a slice: per dataset the newest version of any earlier slice
    newest = versions.groupBy("id", "dataset", "slice", "last").agg(F.max(F.struct("recorded", "batch_seq", (~F.col("deleted")).alias("live"))).alias("v"))
    until = F.lead("slice").over(Window.partitionBy("id", "dataset").orderBy("slice"))
    begin, end = F.col("slice") + 1, F.coalesce(F.col("until"), F.col("last"))
    carried = (
        newest.withColumn("until", until)
        .where(begin <= end)
        .select("id", "dataset", F.col("v.recorded").alias("recorded"), F.col("v.batch_seq").alias("batch_seq"), (~F.col("v.live")).alias("deleted"), F.explode(F.sequence(begin, end)).alias("slice"))
    )
    references = hot.where(F.col("kind") == REFERENCE)
    salts = references.groupBy("id", "slice").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("salts"))
    salts = F.broadcast(materialise(salts.where("salts > 1"), "salts"))  # at most a row for every ``limit`` references
    held = versions.drop("last").unionByName(carried).join(salts, ["id", "slice"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    held = held.drop("salts").withColumns({"kind": F.lit(PARENT), "known": F.lit(True)})
    spread = references.join(salts, ["id", "slice"], "left").withColumn("salt", F.pmod(F.xxhash64("dataset", "seq", "predicate"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts", "last")
    return cold.unionByName(spread).unionByName(held, allowMissingColumns=True)


def orphans(log: DataFrame, namespaces: Namespaces, hot_events: int = HOT_EVENTS) -> DataFrame:
    """``(dataset, period_ym, seq, predicate, target_id, reason)``: every orphaned reference.

    Versions and references are co-partitioned by id and sorted by time; one pass over
    both keeps, by the validity intervals of the versions (a version holds from its
    recorded to its dataset's next), the number of datasets in which the id is live:
    ``missing`` has no version at all, ``late`` only later ones, ``deleted`` none live.
    Ids with very many events are cut into time slices, each begun with the state before it.

    Ties: of a dataset's versions with equal (recorded, batch_seq) a live one counts.
    Rows with null dataset, recorded or (for references) seq, and null ids, take no part;
    null deleted is not deleted. Repeated rows and repeated names give one result row.
    """
    events = _sliced(materialise(events_of(log, namespaces), "id-events"), hot_events).repartition("id", "slice", "salt")
    live = F.when((F.col("kind") == PARENT) & ~F.col("deleted"), 1).otherwise(0)
    versions = Window.partitionBy("id", "slice", "salt", "kind", "dataset").orderBy("recorded", "batch_seq", F.col("deleted").desc())
    before = F.coalesce(F.lag("live").over(versions), F.lit(0))
    steps = events.withColumn("live", live).withColumn("step", F.when(F.col("kind") == PARENT, F.col("live") - before).otherwise(0))
    merged = Window.partitionBy("id", "slice", "salt").orderBy("recorded", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.when(F.col("kind") == PARENT, 1).otherwise(0)).over(merged)
    # equal times: all versions sort before all references, so the sums are complete at each reference
    state = steps.withColumns({"lives": F.sum("step").over(merged), "seen": seen})
    whole = Window.partitionBy("id", "slice", "salt").orderBy(F.col("recorded").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = F.sum(F.when(F.col("kind") == PARENT, 1).otherwise(0)).over(whole)
    state = state.withColumn("later", later).where(F.col("kind") == REFERENCE)
    reason = (
        F.when((F.col("seen") == 0) & ((F.col("later") > 0) | F.coalesce("known", F.lit(False))), "late")
        .when(F.col("seen") == 0, "missing")
        .when(F.col("lives") == 0, "deleted")
    )
    month = F.date_format(F.timestamp_seconds(F.floor(F.col("recorded") / 1_000_000_000)), "yyyy-MM")
    return (
        state.withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .select("dataset", month.alias("period_ym"), "seq", "predicate", F.col("id").alias("target_id"), "reason")
        .distinct()
    )


def orphans_by_period(found: DataFrame) -> DataFrame:
    """The report per dataset, month and reason: references and distinct targets."""
    return found.groupBy("dataset", "period_ym", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("target_id").alias("n_targets"))
