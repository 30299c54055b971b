"""The one stored relation: an append-only log of entity versions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .identity import Namespaces
from .jsoncanon import canonical_content

#: Columns of the log that operators work on.
COLUMNS = ("dataset", "seq", "entity_id", "recorded", "batch_seq", "deleted", "props", "refs")
SCHEMA = "dataset string, seq bigint, entity_id string, recorded bigint, batch_seq bigint, deleted boolean, props string, refs string"

#: Newest version first by these; ``seq`` separates a version from the same one sent again.
VERSION_ORDER = ("recorded", "batch_seq", "seq")


def change_table(raw: DataFrame, namespaces: Namespaces, distinct: bool = True) -> DataFrame:
    """The canonical log of a raw one: CURIE ids, no null flags or maps, each (dataset, seq) once.

    ``distinct=False`` skips the removal of repeated rows for operators that repeats cannot
    change (newest versions, relations), which saves a shuffle of the whole log.
    """
    rows = namespaces.compress(raw.select("dataset", "seq", "id", "recorded", "batch_seq", "deleted", "props", "refs").where("dataset IS NOT NULL AND id IS NOT NULL"), "id")
    rows = rows.select(
        "dataset",
        "seq",
        F.col("id").alias("entity_id"),
        "recorded",
        F.coalesce("batch_seq", F.lit(0)).cast("bigint").alias("batch_seq"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.coalesce("props", F.lit("{}")).alias("props"),
        F.coalesce("refs", F.lit("{}")).alias("refs"),
    )
    return rows.dropDuplicates(["dataset", "seq"]) if distinct else rows


def ref_pairs(refs: Column) -> Column:
    """Array of (predicate, target) of a refs JSON text; a target is a string, alone or in a list.

    Null, broken or non-object texts, nulls, empty lists and values that are no strings hold nothing.
    """
    by_name = F.from_json(refs, "map<string,variant>")
    text = lambda v: F.try_variant_get(v, "$", "string")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    single = lambda k, v: F.array(F.struct(k.alias("predicate"), text(v).alias("target")))
    many = lambda k, v: F.transform(
        F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda e: e.isNotNull() & is_text(e)),
        lambda e: F.struct(k.alias("predicate"), text(e).alias("target")),
    )
    pairs = F.transform(
        F.map_entries(by_name),
        lambda e: F.when(e["value"].isNull(), F.lit(None))
        .when(is_text(e["value"]), single(e["key"], e["value"]))
        .when(F.schema_of_variant(e["value"]).startswith("ARRAY"), many(e["key"], e["value"])),
    )
    return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))


def prop_texts(props: Column) -> Column:
    """Map of property name to its value as canonical JSON text; null properties are absent."""
    kept = F.map_filter(F.from_json(props, "map<string,variant>"), lambda k, v: v.isNotNull() & (F.schema_of_variant(v) != "VOID"))
    return F.transform_values(kept, lambda k, v: F.to_json(v))


@F.pandas_udf(T.BinaryType())
def _mark(deleted: pd.Series, props: pd.Series, refs: pd.Series) -> pd.Series:
    return pd.Series([hashlib.blake2b((b"-" if d else b"+") + canonical_content(p, r, null_refs=False), digest_size=16).digest() for d, p, r in zip(deleted, props, refs)])


def content_key(changes: DataFrame) -> DataFrame:
    """``changes`` with a ``content_key`` that is equal exactly for equal deletion state, refs and props.

    Numbers compare by value, key order and spelling do not matter, a string differs from a
    one-element list, null properties and references count as absent. Two versions with equal keys are the same content written twice.
    """
    return changes.withColumn("content_key", _mark("deleted", "props", "refs"))


def newest(changes: DataFrame, keys: tuple[str, ...] = ("dataset", "entity_id"), payload: tuple[str, ...] = ("deleted", "props", "refs")) -> DataFrame:
    """The newest version per key, reduced on the map side before anything is shuffled."""
    order = F.struct(*VERSION_ORDER)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*VERSION_ORDER, *payload), order).alias("v")).select(*keys, "v.*")


def per_entity(*order: Column) -> "Window":
    return Window.partitionBy("dataset", "entity_id").orderBy(*order)
