"""Entity documents: parsing and writing of entity streams, transactions and JSON-LD."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jsoncanon import canonical, parse
from ..model import prop_texts

CONTEXT, CONTINUATION = "@context", "@continuation"

_ROWS = "entity_id string, recorded bigint, deleted boolean, props string, refs string"


class FormatError(ValueError):
    """A document that breaks the entity format."""


def _full(name: str, context: dict[str, str]) -> str:
    """A name of a document as full URI by the document's own context."""
    if not name:
        raise FormatError("empty identifier")
    if name.startswith(("http://", "https://")):
        return name
    prefix, colon, tail = name.partition(":")
    if not colon:
        prefix, tail = "_", name
    if prefix not in context:
        raise FormatError(f"no expansion for prefix {prefix} of {name}")
    return context[prefix] + tail


def _value(v: Any, context: dict[str, str], in_list: bool = False) -> Any:
    if isinstance(v, list):
        return [_value(x, context, True) for x in v]
    if isinstance(v, dict):
        return _entity(v, context, nested=True)
    if v is None and in_list:
        raise FormatError("null in a list")
    return v


def _entity(obj: dict, context: dict[str, str], nested: bool = False) -> dict:
    """One entity with names in full; null properties are dropped, unknown scalar keys ignored."""
    out: dict[str, Any] = {}
    for key, v in obj.items():
        if key == "id":
            if not isinstance(v, str):
                raise FormatError("id is no string")
            out["id"] = _full(v, context)
        elif key == "deleted":
            out["deleted"] = bool(v)
        elif key == "recorded":
            out["recorded"] = v
        elif key == "props":
            out["props"] = {_full(n, context): _value(x, context) for n, x in (v or {}).items() if x is not None}
        elif key == "refs":
            refs = {}
            for n, x in (v or {}).items():
                targets = x if isinstance(x, list) else [x]
                if not all(isinstance(t, str) for t in targets):
                    raise FormatError(f"reference {n} is no string or list of strings")
                full = [_full(t, context) for t in targets]
                refs[_full(n, context)] = full if isinstance(x, list) else full[0]
            out["refs"] = refs
        elif isinstance(v, (dict, list)):
            raise FormatError(f"unexpected key {key}")
    if not nested and "id" not in out:
        raise FormatError("entity without id")
    return out


def _row(e: dict) -> tuple:
    return e["id"], e.get("recorded"), e.get("deleted", False), canonical(e.get("props", {})), canonical(e.get("refs", {}))


def parse_stream(text: str) -> tuple[list[tuple], str | None]:
    """(rows of entity_id, recorded, deleted, props, refs; continuation token) of an entity stream.

    The first element must be the context. Names come out as full URIs.
    """
    try:
        doc = parse(text)
    except ValueError as error:
        raise FormatError(f"not a whole JSON array: {error}") from error
    if not isinstance(doc, list) or not doc or not isinstance(doc[0], dict) or doc[0].get("id") != CONTEXT:
        raise FormatError("the first element must be the context")
    context = doc[0].get("namespaces") or {}
    rows, token = [], None
    for e in doc[1:]:
        if not isinstance(e, dict):
            raise FormatError("element is no object")
        if e.get("id") == CONTINUATION:
            token = e.get("token")
            continue
        rows.append(_row(_entity(e, context)))
    return rows, token


def parse_entities(text: str) -> list[tuple]:
    """Rows of a JSON array of entities without a context; names stay as they are."""
    try:
        doc = parse(text)
    except ValueError as error:
        raise FormatError(f"not a whole JSON array: {error}") from error
    if not isinstance(doc, list) or not all(isinstance(e, dict) and isinstance(e.get("id"), str) for e in doc):
        raise FormatError("not an array of entities")
    return [(e["id"], e.get("recorded"), bool(e.get("deleted")), canonical(e.get("props") or {}), canonical(e.get("refs") or {})) for e in doc]


def compact_rows(rows: list[tuple], prefixes: dict[str, str]) -> list[tuple]:
    """Rows of :func:`parse_stream` with the names in CURIEs of ``prefixes`` (expansion to prefix); others stay URIs."""

    def name(uri: str) -> str:
        head, sep, tail = uri.rpartition("#" if "#" in uri else "/")
        prefix = prefixes.get(head + sep)
        return uri if prefix is None else f"{prefix}:{tail}"

    def targets(refs: dict) -> dict:
        return {name(n): [name(t) for t in v] if isinstance(v, list) else name(v) for n, v in refs.items()}

    def value(v: Any) -> Any:
        if isinstance(v, list):
            return [value(x) for x in v]
        if isinstance(v, dict):
            change = {"id": name, "props": lambda p: {name(n): value(x) for n, x in p.items()}, "refs": targets}
            return {k: change[k](x) if k in change else x for k, x in v.items()}
        return v

    return [(name(i), rec, d, canonical({name(n): value(v) for n, v in parse(p).items()}), canonical(targets(parse(r)))) for i, rec, d, p, r in rows]


def parse_transaction(text: str) -> dict[str, list[tuple]]:
    """Dataset to rows of a transaction document; the context must come first."""
    try:
        doc = parse(text)
    except ValueError as error:
        raise FormatError(f"not a whole JSON object: {error}") from error
    if not isinstance(doc, dict) or next(iter(doc), None) != CONTEXT:
        raise FormatError("the first key must be the context")
    context = (doc[CONTEXT] or {}).get("namespaces") or {}
    return {ds: [_row(_entity(e, context)) for e in entities] for ds, entities in doc.items() if ds != CONTEXT}


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """Entities of all entity stream files below ``path``, each file parsed by one task.

    ``(path, pos, entity_id, recorded, deleted, props, refs)``; compress the names with
    :class:`~strandlog.identity.Namespaces`. A broken file fails the read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "pos", "entity_id", "recorded", "deleted", "props", "refs"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, _ = parse_stream(content.as_py().decode())
                cols = list(zip(*[(p, i, *r) for i, r in enumerate(rows)])) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "path string, pos bigint, " + _ROWS)


def entity_json(entities: DataFrame) -> DataFrame:
    """``(entity_id, json)``: one entity of a stream per row; columns as in the change log."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    text = F.concat(
        F.lit('{"id":'), quoted("entity_id"), F.lit(',"recorded":'), F.coalesce(F.col("recorded").cast("string"), F.lit("0")),
        F.lit(',"deleted":'), F.col("deleted").cast("string"), F.lit(',"refs":'), F.coalesce("refs", F.lit("{}")), F.lit(',"props":'), F.coalesce("props", F.lit("{}")), F.lit("}"),
    )
    return entities.select("entity_id", text.alias("json"))


def stream_text(context: dict, rows: Iterator[str], token: str | None = None) -> Iterator[str]:
    """The parts of an entity stream document: context, entities, continuation."""
    yield "[" + json.dumps(context)
    for r in rows:
        yield "," + r
    if token is not None:
        yield "," + json.dumps({"id": CONTINUATION, "token": token})
    yield "]"


def _quoted(c: Column) -> Column:
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def jsonld(entities: DataFrame) -> DataFrame:
    """``(entity_id, json)``: JSON-LD nodes; properties inlined, references as ``@id`` objects, lists in order."""
    props = F.transform(F.map_entries(prop_texts(F.col("props"))), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    target = lambda text: F.concat(F.lit('{"@id":'), text, F.lit("}"))
    refs = F.transform(
        F.map_entries(prop_texts(F.col("refs"))),
        lambda e: F.concat(
            _quoted(e["key"]),
            F.lit(":"),
            F.when(e["value"].startswith("["), F.concat(F.lit("["), F.array_join(F.transform(F.from_json(e["value"], "array<string>"), lambda t: target(_quoted(t))), ","), F.lit("]"))).otherwise(target(e["value"])),
        ),
    )
    empty = F.array().cast("array<string>")
    head = F.concat(F.lit('"@id":'), _quoted(F.col("entity_id")))
    parts = F.concat(F.array(head), F.array_sort(F.coalesce(props, empty)), F.array_sort(F.coalesce(refs, empty)))
    return entities.select("entity_id", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"))


#: What ``core`` expands to unless the caller or the namespaces say otherwise.
CORE = "urn:core:"


def jsonld_context(context: dict, core: str = CORE) -> dict:
    """The ``@context`` of JSON-LD output: the namespaces and the two prefixes the format itself uses.

    ``core`` names the terms of the continuation. Its expansion is a matter of
    configuration: a namespace of that prefix counts first, then the argument.
    """
    return {"@context": {"core": core, **context["namespaces"], "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}}


def jsonld_continuation(token: str) -> dict:
    return {"@id": CONTINUATION, "rdf:type": {"@id": "core:continuation"}, "core:token": token}
