"""Compaction, garbage collection, statistics and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import content_key, newest
from ..ordering import with_previous


def compact(changes: DataFrame) -> DataFrame:
    """The log without versions that repeat the version just before them; the first always stays.

    Lookups at any time give the same contents before and after. Works per entity in
    order, but an entity of any number of versions is spread over tasks. Only keys, order
    and content keys are ordered; (dataset, seq), which must be unique, brings the rows back.
    """
    keyed = changes if "content_key" in changes.columns else content_key(changes)
    chained = with_previous(keyed.select("dataset", "entity_id", "recorded", "batch_seq", "seq", "content_key"), ["dataset", "entity_id"], ["recorded", "batch_seq", "seq"], "content_key", "previous_key")
    repeats = chained.where("content_key = previous_key").select("dataset", "seq")
    return changes.join(repeats, ["dataset", "seq"], "left_anti")


def collect_garbage(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """The log without the versions of deleted datasets."""
    return changes.join(catalog.where("deleted").select("dataset"), "dataset", "left_anti")


def item_counts(changes: DataFrame) -> DataFrame:
    """``(dataset, items)``: entities ever seen in each dataset; deletes do not lower it."""
    entities = changes.groupBy("dataset", "entity_id").agg(F.lit(1).alias("one"))
    return entities.groupBy("dataset").agg(F.count(F.lit(1)).alias("items"))


def statistics(changes: DataFrame) -> DataFrame:
    """``(dataset, deleted, versions, key_bytes, value_bytes)`` with subtotals per dataset and over all.

    A subtotal has null in the columns it sums over. Key bytes are those of dataset and
    id, value bytes those of props and refs.
    """
    sized = changes.select("dataset", "deleted", (F.octet_length("dataset") + F.octet_length("entity_id")).alias("k"), (F.octet_length("props") + F.octet_length("refs")).alias("v"))
    return sized.rollup("dataset", "deleted").agg(F.count(F.lit(1)).alias("versions"), F.sum("k").alias("key_bytes"), F.sum("v").alias("value_bytes"))


def index_statistics(changes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``(source, dataset, deleted, n, key_bytes, value_bytes)`` of the log, its newest versions and their links, with subtotals.

    ``source`` is ``log``, ``latest`` or ``links``; links are of live versions only.
    """
    size = [(F.octet_length("dataset") + F.octet_length("entity_id")).alias("k"), (F.octet_length("props") + F.octet_length("refs")).alias("v")]
    rows = changes.select(F.lit("log").alias("source"), "dataset", "deleted", *size).unionByName(newest(changes).select(F.lit("latest").alias("source"), "dataset", "deleted", *size))
    if links is not None:
        width = F.octet_length("subject") + F.octet_length("predicate") + F.octet_length("object")
        rows = rows.unionByName(links.select(F.lit("links").alias("source"), "dataset", F.lit(False).alias("deleted"), (F.octet_length("dataset") + width).alias("k"), F.lit(0).alias("v")))
    return rows.rollup("source", "dataset", "deleted").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_bytes"), F.sum("v").alias("value_bytes"))


def lineage_row(config: dict) -> tuple:
    """A job configuration as a row ``(sources, sinks, transforms, hops, transactions)`` for :func:`lineage`."""
    source, sink = config.get("source") or {}, config.get("sink") or {}
    names = [c["Name"] for c in source.get("DatasetSources", [])] or [x for x in (source.get("Name") or source.get("Url"),) if x]
    target = sink.get("Name") or sink.get("Url")
    return names, [target] if target else [], bool(config.get("transform")), list(config.get("hops") or []), list(config.get("transactions") or [])


LINEAGE_JOBS = "sources array<string>, sinks array<string>, transforms boolean, hops array<string>, transactions array<string>"


def lineage(jobs: DataFrame, dataset: str | None = None) -> DataFrame:
    """``(from_name, to_name, rel_type)`` edges of job configurations, sorted.

    ``jobs`` has ``sources`` and ``sinks`` (arrays), ``transforms`` (boolean), ``hops``
    (datasets that the transform queries) and ``transactions`` (datasets it writes).
    Sources copy to sinks, or transform to them; queried datasets and transaction sinks
    give ``-hop`` edges. With ``dataset`` only its own edges.
    """
    kind = F.when(F.coalesce("transforms", F.lit(False)), "transform").otherwise("copy")
    empty = F.array().cast("array<string>")
    j = jobs.select(F.coalesce("sources", empty).alias("a"), F.coalesce("sinks", empty).alias("b"), F.coalesce("hops", empty).alias("h"), F.coalesce("transactions", empty).alias("t"), kind.alias("kind"))

    def edges(frm: str, to: str, suffix: str) -> DataFrame:
        return j.select(F.explode(frm).alias("from_name"), to, "kind").select("from_name", F.explode(to).alias("to_name"), F.concat("kind", F.lit(suffix)).alias("rel_type"))

    both = edges("a", "b", "").unionByName(edges("h", "b", "-hop")).unionByName(edges("a", "t", "-hop")).distinct()
    if dataset is not None:
        both = both.where((F.col("from_name") == dataset) | (F.col("to_name") == dataset))
    return both.orderBy("from_name", "to_name", "rel_type")
