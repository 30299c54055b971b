import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators.current_state import newest_first, time_batches

from .conftest import rows_of, set_of

SCHEMA = "dataset string, id string, recorded bigint, batch_seq int, deleted boolean"


def brute(rows: list[tuple]) -> set[tuple]:
    best: dict = {}
    for ds, i, rec, b, dele in rows:
        if ds is None or i is None:
            continue
        key = (rec is not None, rec or 0, b is not None, b or 0, not dele)
        if (ds, i) not in best or key > best[ds, i][0]:
            best[ds, i] = (key, rec, b, dele)
    return {(ds, i, rec, b) for (ds, i), (_, rec, b, dele) in best.items() if not dele}


def history(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", rng.randrange(100), rng.randrange(4), rng.choice([True, False, None])) for _ in range(n)]
    return rows + rng.sample(rows, n // 10)


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_random_feeds_in_any_number_of_batches(spark, n):
    rows = history(n, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    assert set_of(newest_first(time_batches(df, "recorded", n))) == brute(rows)
    *batches, base = time_batches(df, "recorded", n)
    assert set_of(newest_first(batches, base) if batches else newest_first([base])) == brute(rows)


def test_base_rows_stay_where_untouched(spark):
    base = spark.createDataFrame([("d", "a", 1, 0, False, "old a"), ("d", "b", 1, 0, False, "old b"), ("d", "c", 1, 0, False, "old c")], SCHEMA + ", body string")
    feed = spark.createDataFrame([("d", "a", 2, 0, False, "new a"), ("d", "b", 2, 0, True, None), ("d", "e", 2, 0, None, None)], SCHEMA + ", body string")
    assert set_of(newest_first([feed], base, payload=("body",))) == {("d", "a", 2, 0, "new a"), ("d", "c", 1, 0, "old c"), ("d", "e", 2, 0, None)}


def test_odd_rows(spark):
    long = "x" * 100_000
    rows = [(None, "a", 1, 1, None), ("d", None, 1, 1, None), ("d", "", 1, 1, None), ("d", long, 1, None, None), ("d", "n", None, 1, False), ("d", "n", 0, 0, True), ("d", "m", None, None, None), ("d", "t", 5, 5, True), ("d", "t", 5, 5, False)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"image": F.lit(1), "live": F.lit("x")})
    assert set_of(newest_first(time_batches(df, "recorded", 3))) == brute(rows) == {("d", "", 1, 1), ("d", long, 1, None), ("d", "m", None, None), ("d", "t", 5, 5)}


def test_empty(spark):
    assert rows_of(newest_first(time_batches(spark.createDataFrame([], SCHEMA), "recorded", 4))) == []
