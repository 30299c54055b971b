"""Attribute-value rows into one wide row per entity."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..identity import Namespaces

#: JSON's number grammar.
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:T.*)?", re.DOTALL)
_BLANKS = " \t\r\n"
_INT64 = range(-(2**63), 2**63)

ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}


def _literal(val: str) -> tuple[bool, str] | None:
    """(quoted, text) of a JSON literal; None for null, lists and objects."""
    body = val.strip(_BLANKS)
    if body == "null" or body[:1] in ("[", "{"):
        return None
    if body[:1] == '"':
        try:
            text = json.loads(body, strict=False)
            text.encode()
            return True, text
        except ValueError:  # no JSON string, or one that no UTF-8 column can hold
            return None
    return False, body


def read_cell(val: str | None, dtype: str) -> object | None:
    """The typed value of one literal, or None if it does not fit ``dtype``."""
    literal = _literal(val) if val is not None else None
    if literal is None:
        return None
    quoted, text = literal
    if dtype == "string":
        return text
    text = text.strip(_BLANKS)
    if dtype == "boolean":
        return {"true": True, "false": False}.get(text.lower())
    if dtype == "date":
        m = _DATE.fullmatch(text) if quoted else None
        try:
            return np.datetime64(dt.date(*map(int, m.groups())), "D") if m else None
        except ValueError:
            return None
    if not _NUMBER.fullmatch(text):
        return None
    if dtype == "double":
        number = float(text)
        return number if abs(number) != float("inf") else None
    exact = Decimal(text)
    if exact.is_zero():
        return 0
    if exact.adjusted() > 18 or exact != exact.to_integral_value():
        return None
    whole = int(exact)
    return whole if whole in _INT64 else None


#: The column of a parsed row that holds the value of each type.
_VALUE = {"string": "v_string", "bigint": "v_bigint", "double": "v_double", "boolean": "v_boolean", "date": "v_date"}
_JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"


def parsed(rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """``rows`` (dataset, id, attr, val) with the value in the column of its attribute's type.

    What SQL functions read exactly as :func:`read_cell` does is read by them: unquoted
    literals, quoted ones without escapes, numbers. The rest (escapes, whole numbers
    spelled with a fraction or exponent) stays in ``rest`` for that function.
    """
    types = rows.sparkSession.createDataFrame(columns, "attr string, dtype string")  # as many rows as the result has columns
    blanks = F.lit(_BLANKS)
    body = F.btrim("val", blanks)
    quoted, empty = F.col("body").startswith('"'), (F.col("body") == "null") | F.col("body").startswith("[") | F.col("body").startswith("{")
    bare = F.col("body").rlike(r'^"[^"\\\x00-\x1f]*"\z')
    text = F.when(bare, F.expr("substring(body, 2, length(body) - 2)")).when(~quoted & ~empty, F.col("body"))
    typed = rows.join(F.broadcast(types), "attr", "left").withColumn("body", body).withColumn("text", text).withColumn("inner", F.btrim("text", blanks))
    of = lambda dtype, value: F.when(F.col("dtype") == dtype, value)
    inner, number = F.col("inner"), F.col("inner").rlike(_JSON_NUMBER)
    whole = inner.rlike(r"^-?(0|[1-9][0-9]{0,17})\z")
    double = F.when(number, inner.try_cast("double"))
    day = F.when(quoted & inner.rlike(r"(?s)^[0-9]{4}-[0-9]{2}-[0-9]{2}(T.*)?\z") & ~inner.startswith("0000"), F.left(inner, F.lit(10)).try_cast("date"))
    left_over = (quoted & ~bare) | ((F.col("dtype") == "bigint") & number & ~whole)
    return typed.select(
        "dataset",
        "id",
        "attr",
        of("string", F.col("text")).alias("v_string"),
        of("bigint", F.when(whole, inner.try_cast("bigint"))).alias("v_bigint"),
        of("double", F.when(F.abs(double) < float("inf"), double)).alias("v_double"),
        of("boolean", F.when(F.lower(inner).isin("true", "false"), F.lower(inner) == "true")).alias("v_boolean"),
        of("date", day).alias("v_date"),
        F.when(F.col("dtype").isNotNull() & left_over, F.col("val")).alias("rest"),
    )


def _scatter(table: pa.Table, columns: list[tuple[str, str]]) -> pa.RecordBatch:
    """Whole entities (rows sorted by entity) to one wide batch: codes of entity and attribute
    are the row and column where a numpy array per type is told which value stands there."""
    place = {attr: i for i, (attr, _) in enumerate(columns)}
    flat = {n: table.column(n).combine_chunks() for n in table.column_names}
    entities = pc.binary_join_element_wise(flat["dataset"], flat["id"], "\x00").dictionary_encode()
    attrs = flat["attr"].dictionary_encode()
    row = entities.indices.to_numpy(zero_copy_only=False)
    # dictionary code of an attribute to its column, once per distinct attribute; -1: no column
    column_of = np.array([place.get(a, -1) for a in attrs.dictionary.to_pylist()], dtype=np.int64)
    col = column_of[attrs.indices.to_numpy(zero_copy_only=False)] if len(attrs) else np.zeros(0, np.int64)
    n = len(entities.dictionary)
    first = np.zeros(n, dtype=np.int64)
    first[row[::-1]] = np.arange(len(row))[::-1]
    rest = np.nonzero(flat["rest"].is_valid().to_numpy(zero_copy_only=False))[0]
    wide: dict[int, pa.Array] = {}
    for dtype in {t for _, t in columns}:
        members = [i for i, (_, t) in enumerate(columns) if t == dtype]
        local = np.full(len(columns) + 1, -1, dtype=np.int64)
        local[members] = np.arange(len(members))
        values = flat[_VALUE[dtype]]
        at = np.nonzero(values.is_valid().to_numpy(zero_copy_only=False))[0]
        where = np.full((n, len(members)), -1, dtype=np.int64)
        where[row[at], local[col[at]]] = at
        own = rest[local[col[rest]] >= 0]
        cells = [(i, read_cell(v, dtype)) for i, v in zip(own.tolist(), flat["rest"].take(pa.array(own)).to_pylist())]
        cells = [(i, c.item() if dtype == "date" else c) for i, c in cells if c is not None]
        if cells:
            at = np.array([i for i, _ in cells])
            where[row[at], local[col[at]]] = len(values) + np.arange(len(cells))
            values = pa.concat_arrays([values, pa.array([c for _, c in cells], ARROW[dtype])])
        for k, c in enumerate(members):
            wide[c] = values.take(pa.array(where[:, k], mask=where[:, k] < 0))
    arrays = [*(flat[c].take(pa.array(first)) for c in ("dataset", "id")), *(wide[i] for i in range(len(columns)))]
    return pa.RecordBatch.from_arrays(arrays, ["dataset", "id", *(f"c{i}" for i in range(len(columns)))])


def _wide(batches: Iterator[pa.RecordBatch], columns: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None  # the last entity of a batch may go on in the next
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        d, i = table.column("dataset"), table.column("id")
        cut = table.num_rows - 1
        last = (d[cut].as_py(), i[cut].as_py())
        while cut > 0 and (d[cut - 1].as_py(), i[cut - 1].as_py()) == last:
            cut -= 1
        if cut:
            yield _scatter(table.slice(0, cut), columns)
        held = table.slice(cut)
    if held is not None:
        yield _scatter(held, columns)


def column_types(attr_types: DataFrame, max_columns: int = 5_000) -> list[tuple[str, str]]:
    """(attr, dtype) in order of name; the list is the schema of the result, so it is bounded and checked."""
    rows = attr_types.where("attr IS NOT NULL").groupBy("attr").agg(F.min("dtype").alias("dtype")).limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    return sorted((r.attr, r.dtype) for r in rows)


def widen(attrs: DataFrame, attr_types: DataFrame, namespaces: Namespaces, buckets: int | None = None) -> DataFrame:
    """``(dataset, id, <one column per attribute, of its declared type>)``: one row per entity.

    The newest row per (dataset, id, attr) decides (equal recorded: the greatest text,
    null last; null recorded counts as oldest); repeats are reduced before rows travel.
    Values are read by their attribute's type, entities then hash-bucketed, sorted,
    dictionary-encoded and scattered by one numpy array per type. A value that is null, a list, an object or does not fit its
    column is null; unlisted attributes are left out, but an entity with only such still
    has its row. Rows with a null dataset or id name no entity. Columns are called like
    the attribute; ``dataset`` and ``id`` as attribute names get a trailing ``_``.
    """
    columns = column_types(attr_types)
    rows = attrs.where("dataset IS NOT NULL AND id IS NOT NULL").select("dataset", "id", F.coalesce("attr", F.lit("")).alias("attr"), "val", "recorded")
    rows = namespaces.compress(rows, "id", "attr")
    # unlisted attributes are one here, so an entity never has more rows than columns, whatever it lists
    listed = F.col("attr").isin([a for a, _ in columns])
    rows = rows.select("dataset", "id", F.when(listed, F.col("attr")).otherwise("\u0000").alias("attr"), F.when(listed, F.col("val")).alias("val"), "recorded")
    newest = rows.groupBy("dataset", "id", "attr").agg(F.max(F.struct("recorded", "val")).alias("v")).select("dataset", "id", "attr", "v.val")
    newest = parsed(newest, columns)
    bucketed = newest.repartition(buckets, "dataset", "id") if buckets else newest.repartition("dataset", "id")
    fields = ", ".join(f"c{i} {dtype}" for i, (_, dtype) in enumerate(columns))
    schema = "dataset string, id string" + (", " + fields if fields else "")
    wide = bucketed.sortWithinPartitions("dataset", "id").mapInArrow(lambda it: _wide(it, columns), schema)
    name = lambda a: a + "_" if a in ("dataset", "id") else a
    return wide.toDF("dataset", "id", *[name(a) for a, _ in columns])


def _thousandths(value: Column) -> Column:
    return F.round(value.try_cast("decimal(38,10)") * 1000).try_cast("decimal(38,0)").cast("string")


def long_cells(wide: DataFrame) -> DataFrame:
    """``(dataset, id, attr, cell)``: the non-null cells as text (doubles as thousandths)."""

    def text(name: str, dtype: str) -> Column:
        c = F.col(f"`{name.replace('`', '``')}`")
        if dtype == "double":
            # past the decimal's range the double has no fraction left, so it is scaled as it is
            return F.when(c.isNotNull(), F.coalesce(_thousandths(c), F.format_string("%.0f", c * 1000)))
        return c.cast("string")

    cells = [F.struct(F.lit(n).alias("attr"), text(n, t).alias("cell")) for n, t in wide.dtypes if n not in ("dataset", "id")]
    if not cells:
        return wide.select("dataset", "id", F.lit("").alias("attr"), F.lit("").alias("cell")).where("false")
    return wide.select("dataset", "id", F.inline(F.array(*cells))).where("cell IS NOT NULL")
