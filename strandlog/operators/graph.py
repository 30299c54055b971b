"""Relations, traversals, lookups and merges derived from newest versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..identity import Namespaces
from ..model import prop_texts, ref_pairs
from ..session import materialise
from .snapshot import latest

ANY = "*"


def relations(changes: DataFrame, namespaces: Namespaces | None = None, at: int | None = None) -> DataFrame:
    """``(dataset, subject, predicate, object, recorded)``: the links of every live newest version.

    Repeated targets of one predicate are one link. This replaces both link indexes: what
    is visible at a time follows from the versions of that time alone.
    """
    live = latest(changes, at, include_deleted=False, payload=("refs",))
    links = live.select("dataset", F.col("entity_id").alias("subject"), "recorded", F.explode(F.array_distinct(ref_pairs(F.col("refs")))).alias("r")).select(
        "dataset", "subject", F.col("r.predicate").alias("predicate"), F.col("r.target").alias("object"), "recorded"
    )
    return namespaces.compress(links, "predicate", "object") if namespaces is not None else links


def hop(starts: DataFrame, links: DataFrame, predicate: str = ANY, inverse: bool = False, datasets: list[str] | None = None) -> DataFrame:
    """``(start_id, predicate, related_id, recorded)``: one hop from each start.

    A (start, predicate, related) triple is there once if any dataset in scope has it
    live; ``recorded`` is the newest of those. ``starts`` has a column ``start_id``;
    unknown starts give nothing and repeated starts count once. Starts are broadcast only
    if Spark measures them small.
    """
    here, there = ("object", "subject") if inverse else ("subject", "object")
    rows = links
    if predicate != ANY:
        rows = rows.where(F.col("predicate") == predicate)
    if datasets:
        rows = rows.where(F.col("dataset").isin(datasets))
    hits = rows.join(starts.select(F.col("start_id").alias(here)).distinct(), here, "left_semi")
    return hits.groupBy(F.col(here).alias("start_id"), "predicate", F.col(there).alias("related_id")).agg(F.max("recorded").alias("recorded"))


def page_hop(hops: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """A page of hop results in their fixed order: start, newest first, predicate, related (both descending).

    ``after`` is the last row (start_id, recorded, predicate, related_id) of the page before.
    """
    rows = hops
    if after is not None:
        s, r, p, o = after
        c = F.col
        rows = rows.where(
            (c("start_id") > s)
            | ((c("start_id") == s) & ((c("recorded") < r) | ((c("recorded") == r) & ((c("predicate") < p) | ((c("predicate") == p) & (c("related_id") < o))))))
        )
    return rows.orderBy("start_id", F.col("recorded").desc(), F.col("predicate").desc(), F.col("related_id").desc()).limit(limit)


def multi_hop(starts: DataFrame, links: DataFrame, path: list[tuple[str, bool]]) -> DataFrame:
    """``(start_id, related_id)`` after following (predicate, inverse) steps; ids are reduced between steps."""
    front = starts.select("start_id", F.col("start_id").alias("at")).distinct()
    for predicate, inverse in path:
        here, there = ("object", "subject") if inverse else ("subject", "object")
        step = links if predicate == ANY else links.where(F.col("predicate") == predicate)
        step = step.select(F.col(here).alias("at"), F.col(there).alias("next")).distinct()
        front = front.join(step, "at").select("start_id", F.col("next").alias("at")).distinct()
    return front.select("start_id", F.col("at").alias("related_id"))


def closure(links: DataFrame, predicate: str, max_rounds: int = 64) -> DataFrame:
    """``(subject, object)``: everything reachable over one predicate, by doubling of paths.

    The pairs that a round found new are joined with all pairs known, so a path of n links
    takes about log2(n) rounds and a round costs what it adds; every round's new pairs are
    written out. Loops end when a round adds nothing. The output is all pairs by nature.
    A graph that needs more than ``max_rounds`` rounds is an error, never a part of the result.
    """
    fresh = materialise(links.where(F.col("predicate") == predicate).select("subject", "object").distinct(), "closure")
    known = fresh
    for _ in range(max_rounds):
        longer = fresh.join(known.select(F.col("subject").alias("object"), F.col("object").alias("far")), "object").select("subject", F.col("far").alias("object"))
        fresh = materialise(longer.distinct().join(known, ["subject", "object"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise ValueError(f"paths over {predicate} are longer than {max_rounds} rounds of doubling reach")


def partials(latest_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Newest versions with the internal id of their dataset, which orders merged values."""
    ids = catalog.select("dataset", "dataset_id").dropDuplicates(["dataset"])
    return latest_rows.join(ids, "dataset", "left").withColumn("dataset_id", F.coalesce("dataset_id", F.lit(2**31 - 1)))


def _spread(text: Column) -> Column:
    """The elements of a JSON list, or the value itself, as JSON texts."""
    return F.when(text.startswith("["), F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(text))


def merge_values(parts: DataFrame) -> DataFrame:
    """``(entity_id, kind, name, value)``: properties and references of an entity's live versions, merged.

    A name in one dataset only keeps its value; in several the values are joined into one
    list in order of the datasets' internal ids, lists element by element, repeats kept.
    Null properties are absent. ``value`` is canonical JSON text.
    """
    live = parts.where("NOT deleted")
    named = live.select(
        "entity_id",
        "dataset_id",
        F.explode(
            F.concat(
                F.transform(F.map_entries(prop_texts(F.col("props"))), lambda e: F.struct(F.lit("prop").alias("kind"), e["key"].alias("name"), e["value"].alias("text"))),
                F.transform(F.map_entries(prop_texts(F.col("refs"))), lambda e: F.struct(F.lit("ref").alias("kind"), e["key"].alias("name"), e["value"].alias("text"))),
            )
        ).alias("p"),
    ).select("entity_id", "dataset_id", "p.*")
    # one entry per dataset that has the name: bounded by the number of datasets
    grouped = named.groupBy("entity_id", "kind", "name").agg(F.array_sort(F.collect_list(F.struct("dataset_id", "text"))).alias("l"))
    joined = F.flatten(F.transform("l", lambda x: _spread(x["text"])))
    value = F.when(F.size("l") == 1, F.col("l")[0]["text"]).otherwise(F.concat(F.lit("["), F.array_join(joined, ","), F.lit("]")))
    return grouped.select("entity_id", "kind", "name", value.alias("value"))


def merged_entities(parts: DataFrame) -> DataFrame:
    """``(entity_id, deleted, recorded, n_partials, props, refs)``: one row per entity over all its datasets.

    An entity with a live version shows only live ones; one without is an empty placeholder
    with ``deleted`` true. ``recorded`` is that of the first part in dataset order.
    """
    values = merge_values(parts)
    maps = values.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "prop", F.struct("name", "value"))))).alias("props"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "ref", F.struct("name", "value"))))).alias("refs"),
    )
    heads = parts.groupBy("entity_id").agg(
        F.min("deleted").alias("deleted"),
        F.coalesce(F.min_by("recorded", F.when(~F.col("deleted"), F.col("dataset_id"))), F.min_by("recorded", "dataset_id")).alias("recorded"),
        F.sum(F.when(~F.col("deleted"), 1).otherwise(0)).alias("n_partials"),
    )
    return heads.join(maps, "entity_id", "left")


def multi_origin(parts: DataFrame) -> DataFrame:
    """``(entity_id, position, dataset, deleted, recorded, props, refs)``: the parts of each entity, not merged.

    Live parts if there are any, else the tombstones, in order of the datasets' ids.
    """
    any_live = parts.groupBy("entity_id").agg(F.max(~F.col("deleted")).alias("any_live"))
    shown = parts.join(any_live, "entity_id").where("NOT deleted OR NOT any_live")
    # one entry per dataset that has the entity: bounded by the number of datasets
    lists = shown.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("dataset_id", "dataset", "deleted", "recorded", "props", "refs"))).alias("l"))
    return lists.select("entity_id", F.posexplode("l").alias("position", "p")).select("entity_id", "position", "p.dataset", "p.deleted", "p.recorded", "p.props", "p.refs")


def with_partials(parts: DataFrame, partials: str = "core:partials", dataset_name: str = "core:datasetname") -> DataFrame:
    """``(entity_id, deleted, props, refs)``: one entity whose property ``partials`` lists its parts.

    Every part keeps its own properties and references and gets the property
    ``dataset_name``; the entity itself has no references.
    """
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    tag = F.concat(quoted(F.lit(dataset_name)), F.lit(":"), quoted(F.col("dataset")))
    body = F.expr("substring(trim(props), 2, length(trim(props)) - 2)")
    props = F.concat(F.lit("{"), tag, F.when(F.trim(body) == "", "").otherwise(F.concat(F.lit(","), body)), F.lit("}"))
    text = F.concat(F.lit('{"id":'), quoted(F.col("entity_id")), F.lit(',"deleted":'), F.col("deleted").cast("string"), F.lit(',"props":'), props, F.lit(',"refs":'), F.col("refs"), F.lit("}"))
    lists = multi_origin(parts).select("entity_id", "position", "deleted", text.alias("part")).groupBy("entity_id").agg(F.min("deleted").alias("deleted"), F.array_sort(F.collect_list(F.struct("position", "part"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["part"]), ",")
    return lists.select("entity_id", "deleted", F.concat(F.lit("{"), quoted(F.lit(partials)), F.lit(":["), joined, F.lit("]}")).alias("props"), F.lit("{}").alias("refs"))


def hydrate(hops: DataFrame, entities: DataFrame) -> DataFrame:
    """Hop results with their related entity; a missing target is a placeholder (recorded 0)."""
    side = entities.select(F.col("entity_id").alias("related_id"), F.col("recorded").alias("entity_recorded"), "deleted", "n_partials")
    rows = hops.join(side, "related_id", "left")
    return rows.select("start_id", "predicate", "related_id", F.coalesce("entity_recorded", F.lit(0)).alias("entity_recorded"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.col("n_partials").isNotNull().alias("resolved"))


def lookup(changes: DataFrame, catalog: DataFrame, ids: list[str], datasets: list[str] | None = None, at: int | None = None) -> DataFrame:
    """Merged entities by CURIE; unknown ids come back as bare placeholders."""
    spark = changes.sparkSession
    rows = changes.where(F.col("entity_id").isin(ids))  # before the reduction; give a raw log filtered by Namespaces.spellings
    if datasets:
        rows = rows.where(F.col("dataset").isin(datasets))
    found = merged_entities(partials(latest(rows, at), catalog))
    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "entity_id string")
    return wanted.join(found, "entity_id", "left")


def entity_details(changes: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """``(entity_id, dataset, latest_seq, latest_recorded, n_changes)``: an entity's state and history per dataset.

    The changes themselves are the rows of :func:`entity_history`, not a list in one row,
    because an entity may have any number of them.
    """
    rows = changes if ids is None else changes.where(F.col("entity_id").isin(ids))
    details = rows.groupBy("entity_id", "dataset").agg(F.max(F.struct("recorded", "batch_seq", "seq")).alias("top"), F.count(F.lit(1)).alias("n_changes"))
    return details.select("entity_id", "dataset", F.col("top.seq").alias("latest_seq"), F.col("top.recorded").alias("latest_recorded"), "n_changes")


def entity_history(changes: DataFrame, ids: list[str]) -> DataFrame:
    """All versions of the given entities in order, per dataset."""
    return changes.where(F.col("entity_id").isin(ids)).orderBy("entity_id", "dataset", "recorded", "batch_seq", "seq")


def changed_main(changed_ids: DataFrame, steps: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """Ids reached from changed ids through join steps of (links, predicate, inverse)."""
    return reduce(lambda ids, s: multi_hop(ids.select(F.col("entity_id").alias("start_id")), s[0], [(s[1], s[2])]).select(F.col("related_id").alias("entity_id")).distinct(), steps, changed_ids)
