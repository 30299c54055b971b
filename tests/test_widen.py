import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandlog.operators.widen import long_cells, read_cell, widen

from .conftest import rows_of, set_of

SCHEMA = "dataset string, id string, attr string, val string, recorded bigint"
TYPES = [("ns3:s", "string"), ("ns3:i", "bigint"), ("ns3:f", "double"), ("ns3:b", "boolean"), ("ns3:d", "date")]


@pytest.mark.parametrize(
    ("val", "dtype", "cell"),
    [
        ('"a b "', "string", "a b "), ('"\\u00e9\\n"', "string", "é\n"), ("12.0", "string", "12.0"), ("true", "string", "true"), ('""', "string", ""),
        ("null", "string", None), ("[1]", "string", None), ('{"a":1}', "string", None), ('"null"', "string", "null"), (None, "string", None), ("", "string", ""),
        ("12", "bigint", 12), ("12.0", "bigint", 12), ("12e1", "bigint", 120), ('" 12 "', "bigint", 12), ("1200e-2", "bigint", 12), ("12.5", "bigint", None), ("1e-3", "bigint", None),
        ("9223372036854775807", "bigint", 2**63 - 1), ("9223372036854775808", "bigint", None), ("-9223372036854775808", "bigint", -(2**63)), ("1e999999999", "bigint", None), ("-0", "bigint", 0), ("0e99999", "bigint", 0),
        ("+5", "bigint", None), ("05", "bigint", None), ("0x1F", "bigint", None), ('"1,204"', "bigint", None), ("true", "bigint", None), ('""', "bigint", None), ("١٢", "bigint", None),
        ("12.5", "double", 12.5), ("653834e-3", "double", 653.834), (".5", "double", None), ("1.", "double", None), ('"NaN"', "double", None), ("1e999", "double", None), ('" -1.25 "', "double", -1.25),
        ("true", "boolean", True), ('" FALSE "', "boolean", False), ("1", "boolean", None), ('"yes"', "boolean", None),
        ('"2020-02-29"', "date", dt.date(2020, 2, 29)), ('"2021-02-29"', "date", None), ('" 2020-01-02 "', "date", dt.date(2020, 1, 2)), ('"2020-01-02T99"', "date", dt.date(2020, 1, 2)), ('"2020-01-02x"', "date", None), ("2020-01-02", "date", None), ('"0000-01-01"', "date", None),
    ],
)
def test_cells(val, dtype, cell):
    found = read_cell(val, dtype)
    assert (found.item() if dtype == "date" and found is not None else found) == cell


def test_cells_are_read_alike_in_sql(spark, namespaces):
    """Every case above, and odd ones, through the wide table as by :func:`read_cell`."""
    cases = [m for mark in test_cells.pytestmark for m in mark.args[1]]
    odd = ['"a\tb"', '"tab\\t"', '"a"b"', '"open', '"', ' \t"x" \n', '"x"\u2028', "\u2028", '"\u00a0 1"', "1 ", "-", "--1", "1e5", "1E+2", "-0.0", "-12", "123456789012345678", "1234567890123456789", "tRuE", '"\\u0074rue"', '"2020-13-01"', '"2020-01-02T\n"', '"2020-01-02 "', "0000", "1d", "Infinity", "nan", "[", "{", "nul", "\x00"]
    vals = list(dict.fromkeys([c[0] for c in cases] + odd))
    rows = [("d", str(n), a, v, 1) for n, v in enumerate(vals) for a, _ in TYPES]
    wide = {r.id: r.asDict() for r in widen(frame(spark, rows), types(spark), namespaces).collect()}
    for n, v in enumerate(vals):
        for attr, dtype in TYPES:
            want = read_cell(v, dtype)
            assert wide[str(n)][attr] == (want.item() if dtype == "date" and want is not None else want), (v, dtype)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def types(spark):
    return spark.createDataFrame(TYPES, "attr string, dtype string")


def test_wide_rows(spark, namespaces):
    rows = [
        ("d", "ns3:1", "ns3:s", '"old"', 1), ("d", "http://x.invalid/people/1", "http://x.invalid/people/s", '"new"', 2), ("d", "ns3:1", "ns3:s", '"new"', 2),
        ("d", "ns3:1", "ns3:i", "7", 1), ("d", "ns3:1", "ns3:f", "2.5", 1), ("d", "ns3:1", "ns3:b", "TRUE", 1), ("d", "ns3:1", "ns3:d", '"2020-01-02"', 1),
        ("d", "ns3:2", "ns3:i", "8", 1), ("d", "ns3:2", "ns3:i", "x", 2), ("e", "ns3:1", "unlisted", "1", 1),
    ]
    wide = widen(frame(spark, rows), types(spark), namespaces)
    assert wide.columns == ["dataset", "id", "ns3:b", "ns3:d", "ns3:f", "ns3:i", "ns3:s"]
    assert set_of(wide) == {("d", "ns3:1", True, dt.date(2020, 1, 2), 2.5, 7, "new"), ("d", "ns3:2", None, None, None, None, None), ("e", "ns3:1", None, None, None, None, None)}
    assert set_of(long_cells(wide)) == {("d", "ns3:1", a, c) for a, c in [("ns3:b", "true"), ("ns3:d", "2020-01-02"), ("ns3:f", "2500"), ("ns3:i", "7"), ("ns3:s", "new")]}


def test_many_entities_over_batches(spark, namespaces):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # entities go on from batch to batch
    try:
        rows = [("d", f"e{i}", f"a{j}", str(i * j), 1) for i in range(50) for j in range(5)]
        kinds = spark.createDataFrame([(f"a{j}", "bigint") for j in range(5)], "attr string, dtype string")
        wide = widen(frame(spark, rows), kinds, namespaces, buckets=2)
        assert set_of(wide) == {("d", f"e{i}", *(i * j for j in range(5))) for i in range(50)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark, namespaces):
    long = "z" * 300_000
    rows = [(None, "a", "ns3:s", "1", 1), ("d", None, "ns3:s", "1", 1), ("d", "a", None, "1", 1), ("d", "a", "ns3:s", None, 1), ("d", "a", "ns3:f", "1", None), ("d", "b", "ns3:s", f'"{long}"', 1), ("d", "", "ns3:s", '"\\ud800"', 1), ("d", "t", "ns3:i", "1", 5), ("d", "t", "ns3:i", "2", 5)]
    df = frame(spark, rows).withColumns({"v": F.lit(1), "c0": F.lit("x"), "cell": F.lit("y")})
    assert set_of(long_cells(widen(df, types(spark), namespaces))) == {("d", "a", "ns3:f", "1000"), ("d", "b", "ns3:s", long), ("d", "t", "ns3:i", "2")}


def test_thousandths_of_extreme_doubles(spark, namespaces):
    rows = [("d", str(i), "ns3:f", v, 1) for i, v in enumerate(["0.001", "-0.0", "123456789012.345", "1e22", "1e300"])]
    cells = {r.id: r.cell for r in long_cells(widen(frame(spark, rows), types(spark), namespaces)).collect()}
    assert [cells[str(i)] for i in range(4)] == ["1", "0", "123456789012345", str(10**25)] and cells["4"].isdigit() and len(cells["4"]) == 304


def test_empty(spark, namespaces):
    wide = widen(frame(spark, []), types(spark), namespaces)
    assert rows_of(wide) == [] and len(wide.columns) == 7
    none = widen(frame(spark, [("d", "a", "x", "1", 1)]), spark.createDataFrame([], "attr string, dtype string"), namespaces)
    assert rows_of(none) == [("d", "a")] and rows_of(long_cells(none)) == []
