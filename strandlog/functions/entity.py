"""Column helpers on entities: ``props`` is map<string,string> of JSON texts, ``refs`` map<string,array<string>>.

``typed`` turns the stored JSON columns into these maps, ``stored`` turns them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import prop_texts

RDF_TYPE = "rdf:type"


def typed(changes: DataFrame) -> DataFrame:
    """Stored JSON columns to maps; a single reference becomes a list of one (see ``ref_is_list``)."""
    texts = prop_texts(F.col("refs"))
    is_list = F.transform_values(texts, lambda k, v: v.startswith("["))
    lists = F.transform_values(texts, lambda k, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(F.try_variant_get(F.parse_json(v), "$", "string"))))
    return changes.withColumns({"props": prop_texts(F.col("props")), "refs": lists, "ref_is_list": is_list})


def stored(entities: DataFrame) -> DataFrame:
    """Maps back to stored JSON columns, names sorted."""

    def name(key: Column) -> Column:
        quoted = F.to_json(F.array(key))  # ["name"]
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    def texts(m: Column) -> Column:
        return F.transform(F.map_entries(m), lambda e: F.concat(name(e["key"]), F.lit(":"), e["value"]))

    one = lambda v: F.substring(F.to_json(v), F.lit(2), F.length(F.to_json(v)) - 2)
    refs = F.transform(
        F.map_entries("refs"),
        lambda e: F.concat(name(e["key"]), F.lit(":"), F.when(F.coalesce(F.col("ref_is_list")[e["key"]], F.size(e["value"]) != 1), F.to_json(e["value"])).otherwise(one(e["value"]))),
    )
    joined = lambda parts: F.concat(F.lit("{"), F.array_join(F.array_sort(parts), ","), F.lit("}"))
    return entities.withColumns({"props": joined(texts(F.col("props"))), "refs": joined(refs)}).drop("ref_is_list")


def prefix_field(prefix: str | Column, name: str | Column) -> Column:
    lift = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(lift(prefix), F.lit(":"), lift(name))


def _put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def set_property(props: Column, prefix: str, name: str, value: Column) -> Column:
    """``props`` with the property set, whether it was there or not."""
    return _put(props, prefix_field(prefix, name), value)


def get_property(props: Column, prefix: str, name: str, default: Column | None = None) -> Column:
    """The property's text; absent gives the default (null if none is given)."""
    found = F.try_element_at(props, prefix_field(prefix, name))
    return found if default is None else F.coalesce(found, default)


def add_reference(refs: Column, prefix: str, name: str, targets: Column) -> Column:
    """``refs`` with the reference set to a list of targets; an old one is overwritten."""
    return _put(refs, prefix_field(prefix, name), targets)


def get_reference(refs: Column, prefix: str, name: str, default: Column | None = None) -> Column:
    return get_property(refs, prefix, name, default)


def rename_property(props: Column, prefix: str, name: str, new_prefix: str, new_name: str) -> Column:
    """The property under its new name (replacing one that has it already); absent stays absent."""
    old, new = prefix_field(prefix, name), prefix_field(new_prefix, new_name)
    moved = F.map_concat(F.map_filter(props, lambda k, _: (k != old) & (k != new)), F.create_map(new, F.try_element_at(props, old)))
    return F.when(F.map_contains_key(props, old), moved).otherwise(props)


def remove_property(props: Column, prefix: str, name: str) -> Column:
    key = prefix_field(prefix, name)
    return F.map_filter(props, lambda k, _: k != key)


def set_deleted(deleted: Column | bool) -> Column:
    return F.lit(deleted) if isinstance(deleted, bool) else deleted


def new_entity_from(entities: DataFrame, add_type: str | None = None, copy_props: bool = False, copy_refs: bool = False) -> DataFrame:
    """New entities with the id and deletion state of the given ones, and what is asked to be copied."""
    none_p, none_r = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<string>>")
    refs = F.col("refs") if copy_refs else none_r
    if add_type is not None:
        refs = _put(refs, F.lit(RDF_TYPE), F.array(F.lit(add_type)))
    return entities.select("entity_id", "deleted", (F.col("props") if copy_props else none_p).alias("props"), refs.alias("refs"))


def to_string(text: Column) -> Column:
    """A property's JSON text as plain text: absent is ``undefined``, strings lose their quotes,
    whole numbers have no fraction, other numbers are written shortest."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    plain = F.when(number == F.floor(number), F.format_string("%.0f", number)).otherwise(F.to_json(v))
    return (
        F.when(text.isNull(), "undefined")
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.abs(number) < 1e21), plain)
        .otherwise(text)
    )


def as_entity(text: Column) -> Column:
    """A nested JSON object as an entity struct (id, deleted, props, refs); null if it is none."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    has = F.try_variant_get(v, "$.props", "variant").isNotNull() | F.try_variant_get(v, "$.refs", "variant").isNotNull() | F.try_variant_get(v, "$.id", "variant").isNotNull()
    return F.when(
        kind.startswith("OBJECT") & has,
        F.struct(
            F.try_variant_get(v, "$.id", "string").alias("entity_id"),
            F.coalesce(F.try_variant_get(v, "$.deleted", "boolean"), F.lit(False)).alias("deleted"),
            F.coalesce(F.to_json(F.try_variant_get(v, "$.props", "variant")), F.lit("{}")).alias("props"),
            F.coalesce(F.to_json(F.try_variant_get(v, "$.refs", "variant")), F.lit("{}")).alias("refs"),
        ),
    )


def new_uuid() -> Column:
    return F.uuid()
