"""Deeply nested entity documents to flat related tables by shared inlining."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jsoncanon import canonical, parse
from ..session import materialise

#: Up to this many element names the decision on each is sent to the tasks; more are joined.
MAX_SENT_ELEMENTS = 1_000

_KEY = "record_id"
RECORD = ""  # the element name of the body itself

_NODES = (
    "record_id bigint, delivery string, element string, parent_element string, repeated boolean, node_path string, parent_path string, "
    "ancestors array<struct<element:string,length:int>>, entity_id string, scalars array<struct<key:string,value:string>>, refs array<struct<owner:string,predicate:string,path:string,target:string>>, recorded string, deleted string"
)
_NODES_ARROW = pa.schema(
    [
        ("record_id", pa.int64()),
        ("delivery", pa.string()),
        ("element", pa.string()),
        ("parent_element", pa.string()),
        ("repeated", pa.bool_()),
        ("node_path", pa.string()),
        ("parent_path", pa.string()),
        ("ancestors", pa.list_(pa.struct([("element", pa.string()), ("length", pa.int32())]))),
        ("entity_id", pa.string()),
        ("scalars", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
        ("refs", pa.list_(pa.struct([("owner", pa.string()), ("predicate", pa.string()), ("path", pa.string()), ("target", pa.string())]))),
        ("recorded", pa.string()),
        ("deleted", pa.string()),
    ]
)


def _clean(text: str) -> str:
    """Lone surrogates, which no UTF-8 column can hold, become the replacement character."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _text(value: Any) -> str | None:
    """A plain value as a cell: strings as they are, null as null, others as JSON text."""
    return None if value is None else _clean(value if isinstance(value, str) else canonical(value, ascii=False))


def _references(owner: str, refs: Any) -> list[tuple[str, str, str, str]]:
    found: list[tuple[str, str, str, str]] = []
    if not isinstance(refs, dict):
        return found
    for predicate, value in refs.items():
        todo = [(f"{owner}/@refs/{predicate}", value)]
        while todo:
            path, v = todo.pop()
            if isinstance(v, str):
                found.append((_clean(owner), _clean(predicate), _clean(path), _clean(v)))
            elif isinstance(v, list):
                todo += [(f"{path}/{i}", x) for i, x in enumerate(v)]
    return found


def _mixed(value: Any) -> set[int]:
    """The ids of the lists, ``value`` itself and those within it, that hold an object at any depth."""
    lists = [value] if isinstance(value, list) else []
    for v in lists:  # grows while it is read
        lists += [x for x in v if isinstance(x, list)]
    mixed: set[int] = set()
    for v in reversed(lists):
        if any(isinstance(x, dict) or id(x) in mixed for x in v):
            mixed.add(id(v))
    return mixed


def walk(body: Any) -> Iterator[tuple]:
    """The objects of one parsed body, the body first, each with what belongs to it alone.

    Gives (element, parent element, repeated, path, parent path, ancestors, id, scalars, refs, recorded, deleted);
    the element is the property that holds the object, ``repeated`` tells whether a list does.
    An ancestor is given by the length of its path, which begins the path of the object.
    Lists of plain values stay values of the object, as JSON text. Of a list that holds
    objects every other element is a value too, named by its path (``list/2``, ``list/0/1``).
    """
    if not isinstance(body, dict):
        return
    todo: list[tuple] = [(RECORD, None, False, "", None, [], body)]
    while todo:
        element, parent_element, repeated, path, parent_path, ancestors, obj = todo.pop()
        entity = parent_element is None or "props" in obj or "refs" in obj
        props = obj.get("props") if entity else obj
        refs = obj.get("refs") if entity else None
        scalars: list[tuple[str, str | None]] = []
        line = [*ancestors, (element, len(path))]
        children: list[tuple] = []
        for name, value in props.items() if isinstance(props, dict) else ():
            inner = [("", value)]
            mixed = _mixed(value)
            while inner:
                at, v = inner.pop()
                if isinstance(v, dict):
                    children.append((_clean(name), element, bool(at), _clean(f"{path}/{name}{at}"), path, line, v))
                elif id(v) in mixed:
                    inner += [(f"{at}/{i}", x) for i, x in enumerate(v)]
                else:
                    scalars.append((_clean(f"{name}{at}"), _text(v)))
        own, recorded, deleted = (obj.get("id"), obj.get("recorded"), obj.get("deleted")) if entity else (None, None, None)
        todo += children
        yield element, parent_element, repeated, path, parent_path, ancestors, _clean(own) if isinstance(own, str) else None, scalars, _references(path, refs), _text(recorded), _text(deleted)


def _delivery(body: str) -> str:
    """A mark of a body's text: the first 64 bits of its MD5."""
    return hashlib.md5(body.encode(), usedforsecurity=False).hexdigest()[:16]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for record_id, body in zip(batch.column(_KEY).to_pylist(), batch.column("body").to_pylist()):
            try:
                value = parse(body)
            except ValueError:
                continue
            for row in walk(value):
                rows.append((record_id, _delivery(body), *row))
                size += 1 + len(row[5])
                if size > 50_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    pack = lambda names, items: [None if i is None else [dict(zip(names, x)) for x in i] for i in items]
    cols[7] = pack(("element", "length"), cols[7])
    cols[9] = pack(("key", "value"), cols[9])
    cols[10] = pack(("owner", "predicate", "path", "target"), cols[10])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODES_ARROW)], schema=_NODES_ARROW)


def element_edges(body: Any) -> set[tuple[str, str, bool]]:
    """(element, parent element, repeated) of every object below a parsed body: its share of the schema graph."""
    found: set[tuple[str, str, bool]] = set()
    if not isinstance(body, dict):
        return found
    todo: list[tuple[str, dict]] = [(RECORD, body)]
    while todo:
        element, obj = todo.pop()
        props = obj.get("props") if obj is body or "props" in obj or "refs" in obj else obj
        for name, value in props.items() if isinstance(props, dict) else ():
            inner = [(value, False)] if isinstance(value, (dict, list)) else []
            while inner:
                v, repeated = inner.pop()
                if isinstance(v, dict):
                    found.add((name, element, repeated))
                    todo.append((name, v))
                else:
                    inner += [(x, True) for x in v if isinstance(x, (dict, list))]
    return found


def table_rows(body: Any, own: frozenset[str]) -> list[tuple]:
    """The table rows of one parsed body, given the elements that have tables of their own.

    As in :func:`flat_tables`, without the document's key: (table, path, parent table,
    parent path, enclosing path, id, recorded, deleted, cells, inlined, refs). A row's
    inlined objects are placed into it while the body is walked, so nothing is regrouped.
    """
    rows: list[tuple] = []
    if not isinstance(body, dict):
        return rows
    todo: list[tuple] = [(RECORD, "", None, -1, body)]
    while todo:
        element, path, parent_path, home, obj = todo.pop()
        entity = parent_path is None or "props" in obj or "refs" in obj
        props, refs = (obj.get("props"), obj.get("refs")) if entity else (obj, None)
        key, recorded, deleted = (obj.get("id"), obj.get("recorded"), obj.get("deleted")) if entity else (None, None, None)
        key, recorded, deleted = _clean(key) if isinstance(key, str) else None, _text(recorded), _text(deleted)
        if home < 0 or element in own:
            up = rows[home][:2] if home >= 0 else (None, None)
            home, prefix = len(rows), ""
            rows.append((element, path, *up, parent_path, key, recorded, deleted, [], [], []))
        else:
            prefix = path[len(rows[home][1]) + 1 :] + "/"
            rows[home][9].append((path, parent_path, key, recorded, deleted))
        cells = rows[home][8]
        for name, value in props.items() if isinstance(props, dict) else ():
            if not isinstance(value, (dict, list)):
                cells.append((prefix + _clean(name), _text(value)))
                continue
            inner = [("", value)]
            mixed = _mixed(value)
            while inner:
                at, v = inner.pop()
                if isinstance(v, dict):
                    todo.append((_clean(name), _clean(f"{path}/{name}{at}"), path, home, v))
                elif id(v) in mixed:
                    inner += [(f"{at}/{i}", x) for i, x in enumerate(v)]
                else:
                    cells.append((_clean(f"{prefix}{name}{at}"), _text(v)))
        if refs:
            rows[home][10].extend(_references(path, refs))
    return rows


_CELL, _INLINED, _REF = ("key", "value"), ("node_path", "parent_path", "entity_id", "recorded", "deleted"), ("owner", "predicate", "path", "target")
_TEXTS = ("table_name", "row_path", "parent_table", "parent_path", "enclosing_path", "entity_id", "recorded", "deleted")
_LISTS = {"cells": _CELL, "inlined": _INLINED, "refs": _REF}
_ROWS = "record_id bigint, delivery string, " + ", ".join(f"{n} string" for n in _TEXTS) + ", " + ", ".join(f"{n} array<struct<{','.join(f'{x}:string' for x in fields)}>>" for n, fields in _LISTS.items())


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[int, str, Any]]:
    for record_id, body in zip(batch.column(_KEY).to_pylist(), batch.column("body").to_pylist()):
        try:
            yield record_id, body, parse(body)
        except ValueError:
            continue


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: set[tuple[str, str, bool]] = set()
        for _, _, value in _parsed(batch):
            found |= element_edges(value)
        if found:
            cols = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(map(_clean, cols[0]), pa.string()), pa.array(map(_clean, cols[1]), pa.string()), pa.array(cols[2], pa.bool_())], ["element", "parent_element", "repeated"])


def _row_batch(keys: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    """Rows as one batch; the lists are built from flat columns and offsets."""
    ids = list(zip(*keys))
    cols = list(zip(*rows))
    arrays = [pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.string()), *(pa.array(c, pa.string()) for c in cols[: len(_TEXTS)])]
    for lists, names in zip(cols[len(_TEXTS) :], _LISTS.values()):
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        flat = list(zip(*[x for items in lists for x in items])) or [()] * len(names)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in flat], list(names))))
    return pa.RecordBatch.from_arrays(arrays, [*("record_id", "delivery"), *_TEXTS, *_LISTS])


def _row_batches(batches: Iterator[pa.RecordBatch], own: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys: list[tuple] = []
        rows: list[tuple] = []
        size = 0
        for record_id, body, value in _parsed(batch):
            found = table_rows(value, own)
            keys += [(record_id, _delivery(body))] * len(found)
            rows += found
            size += sum(1 + len(r[8]) + len(r[9]) + len(r[10]) for r in found)
            if size > 50_000:
                yield _row_batch(keys, rows)
                keys, rows, size = [], [], 0
        if rows:
            yield _row_batch(keys, rows)


def _bodies(payloads: DataFrame) -> DataFrame:
    return payloads.where("record_id IS NOT NULL AND body IS NOT NULL").select("record_id", "body")


def document_nodes(payloads: DataFrame) -> DataFrame:
    """One row per object of every body (see :func:`walk`), the body itself included.

    ``delivery`` is a mark of the body's text, so different bodies of one record stay apart.
    Null bodies, bodies that are no JSON and bodies that are no objects give nothing;
    null record ids likewise. Equal deliveries of one record are read once.
    """
    return _bodies(payloads).dropDuplicates(["record_id", "body"]).mapInArrow(_nodes, _NODES)


def schema_graph(nodes: DataFrame) -> DataFrame:
    """``(element, parent_element, repeated)``: the edges of the schema graph over all documents."""
    return nodes.where("parent_element IS NOT NULL").groupBy("element", "parent_element").agg(F.max("repeated").alias("repeated"))


def decide(graph: DataFrame) -> DataFrame:
    """``(element, own_table, reason)`` by shared inlining.

    An element gets a table of its own if it lies in a list (``repeated``) or has several
    parent elements (``shared``); a single parent makes it inlined. An element that can
    contain itself is reached both from outside and from the loop, so at least one
    element of every loop has two parents: ``recursive`` marks those that are directly
    their own parent, longer loops are broken at a shared element.
    """
    each = graph.groupBy("element").agg(F.max("repeated").alias("repeated"), F.count(F.lit(1)).alias("parents"), F.max(F.col("element") == F.col("parent_element")).alias("self"))
    reason = F.when(F.col("self"), "recursive").when(F.col("repeated"), "repeated").when(F.col("parents") > 1, "shared").otherwise("inlined")
    return each.select("element", (reason != "inlined").alias("own_table"), reason.alias("reason"))


def flat_tables(nodes: DataFrame, decisions: DataFrame, max_sent: int = MAX_SENT_ELEMENTS) -> DataFrame:
    """The rows of all tables in one frame: take one table by its ``table_name``.

    ``(record_id, delivery, table_name, row_path, parent_table, parent_path, enclosing_path, entity_id, recorded, deleted, cells, inlined, refs)``:
    (record_id, delivery, row_path) is the key, (record_id, delivery, parent_path) within
    ``parent_table`` the foreign key; ``cells`` maps column names (relative path of inlined properties) to
    values; ``inlined`` lists the paths of the objects that live in this row with the path
    of their nearest enclosing object and their own id, recorded and deleted; ``refs`` the references of all of them. The record
    itself is the table ``''``.

    The decisions go to the tasks if there are at most ``max_sent`` (checked), otherwise
    they are joined to the ancestors of each object.
    """
    few = decisions.where("own_table").select("element").limit(max_sent + 1).collect()
    line = F.concat(F.col("ancestors"), F.array(F.struct(F.col("element").alias("element"), F.length("node_path").alias("length"))))
    if len(few) <= max_sent:
        own = F.array(*[F.lit(e) for e in [RECORD, *sorted(r.element for r in few)]])
        owners = F.filter(line, lambda a: F.array_contains(own, a["element"]))
    else:
        steps = nodes.select("record_id", "delivery", "node_path", F.posexplode(line).alias("at", "a"))
        tables = decisions.where("own_table").select("element").unionByName(decisions.sparkSession.createDataFrame([(RECORD,)], "element string"))
        kept = steps.join(tables, F.col("a.element") == F.col("element"), "left_semi")
        lists = kept.groupBy("record_id", "delivery", "node_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda x: x["a"]).alias("owners"))
        nodes = nodes.join(lists, ["record_id", "delivery", "node_path"])
        owners = F.col("owners")
    table = lambda a: F.struct(a["element"].alias("element"), F.left(F.col("node_path"), a["length"]).alias("path"))
    placed = nodes.withColumn("owners", owners).withColumn("home", table(F.element_at("owners", -1))).withColumn("up", table(F.try_element_at("owners", F.lit(-2))))
    here = F.element_at("owners", -1)["length"] == F.length("node_path")
    prefix = F.when(here, F.lit("")).otherwise(F.concat(F.expr("substring(node_path, length(home.path) + 2)"), F.lit("/")))
    cells = F.transform("scalars", lambda e: F.struct(F.concat(prefix, e["key"]).alias("key"), e["value"].alias("value")))
    placed = placed.select(
        "record_id",
        "delivery",
        "home",
        F.when(here, F.struct("up.element", "up.path", "entity_id", "recorded", "deleted")).alias("own"),
        F.when(~here, F.struct("node_path", "parent_path", "entity_id", "recorded", "deleted")).alias("inlined"),
        F.when(here, F.col("parent_path")).alias("nearest"),
        cells.alias("cells"),
        "refs",
    )
    # the pieces of a row lie in one document, so a group is at most one document
    rows = placed.groupBy("record_id", "delivery", "home").agg(F.max("own").alias("own"), F.max("nearest").alias("nearest"), F.collect_set("inlined").alias("inlined"), F.flatten(F.collect_list("cells")).alias("cells"), F.flatten(F.collect_list("refs")).alias("refs"))
    return rows.select(
        "record_id",
        "delivery",
        F.col("home.element").alias("table_name"),
        F.col("home.path").alias("row_path"),
        F.col("own.element").alias("parent_table"),
        F.col("own.path").alias("parent_path"),
        F.col("nearest").alias("enclosing_path"),
        F.col("own.entity_id").alias("entity_id"),
        F.col("own.recorded").alias("recorded"),
        F.col("own.deleted").alias("deleted"),
        "cells",
        "inlined",
        "refs",
    )


def shared_inlining(payloads: DataFrame, max_sent: int = MAX_SENT_ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """(table rows, decisions) for a table of JSON documents; see :func:`flat_tables`.

    A first pass reads the schema graph off all documents, a second one places every
    object of a document in its table row at once: the only shuffle of the bodies is the
    one that leaves repeated deliveries out. With more than ``max_sent`` elements that
    have tables (checked) the objects become rows of their own and the decisions are
    joined to them; the result is the same.
    """
    edges = _bodies(payloads).select("record_id", "body").mapInArrow(_edge_batches, "element string, parent_element string, repeated boolean")
    decisions = materialise(decide(edges.groupBy("element", "parent_element").agg(F.max("repeated").alias("repeated"))), "elements")
    few = decisions.where("own_table").select("element").limit(max_sent + 1).collect()
    if len(few) > max_sent:
        return flat_tables(materialise(document_nodes(payloads), "nodes"), decisions, max_sent), decisions
    own = frozenset(r.element for r in few)
    return _bodies(payloads).dropDuplicates(["record_id", "body"]).mapInArrow(lambda it: _row_batches(it, own), _ROWS), decisions


def node_links(rows: DataFrame) -> DataFrame:
    """``(record_id, node_kind, node_path, parent_path)`` of every nested object and reference in the flat tables."""
    link = lambda kind, path, up: F.struct(F.lit(kind).alias("node_kind"), path.alias("node_path"), F.coalesce(up, F.lit("")).alias("parent_path"))
    own = F.when(F.col("table_name") != RECORD, F.array(link("object", F.col("row_path"), F.col("enclosing_path"))))
    own = F.coalesce(own, F.array().cast("array<struct<node_kind:string,node_path:string,parent_path:string>>"))
    inlined = F.transform("inlined", lambda i: link("object", i["node_path"], i["parent_path"]))
    refs = F.transform("refs", lambda r: link("ref", r["path"], r["owner"]))
    return rows.select("record_id", F.explode(F.concat(own, inlined, refs)).alias("n")).select("record_id", "n.*").distinct()


def references(rows: DataFrame) -> DataFrame:
    """``(record_id, delivery, table_name, row_path, owner_path, predicate, ref_path, target)``: the table of references.

    (record_id, delivery, row_path) within ``table_name`` is the row that holds the owner,
    ``owner_path`` the entity itself, which may live inlined in that row.
    """
    each = rows.select("record_id", "delivery", "table_name", "row_path", F.explode("refs").alias("r"))
    return each.select("record_id", "delivery", "table_name", "row_path", F.col("r.owner").alias("owner_path"), F.col("r.predicate").alias("predicate"), F.col("r.path").alias("ref_path"), F.col("r.target").alias("target"))


def entities(rows: DataFrame) -> DataFrame:
    """``(record_id, delivery, table_name, row_path, node_path, entity_id, recorded, deleted)`` of the bodies and nested entities that have any of the three keys."""
    keys = ("entity_id", "recorded", "deleted")
    own = F.array(F.struct(F.col("row_path").alias("node_path"), *keys))
    inlined = F.transform("inlined", lambda i: F.struct(i["node_path"].alias("node_path"), *[i[k].alias(k) for k in keys]))
    each = rows.select("record_id", "delivery", "table_name", "row_path", F.explode(F.concat(own, inlined)).alias("n"))
    return each.select("record_id", "delivery", "table_name", "row_path", "n.*").where(F.coalesce(*keys).isNotNull())
