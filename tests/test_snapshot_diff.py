import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.jsoncanon import canonical_content
from strandlog.operators.snapshot_diff import OrdinalIndex, assign_ordinals, compress, snapshot_changes, words

from .conftest import rows_of, set_of

SCHEMA = "dataset string, snapshot_no int, delivered_at timestamp_ntz, id string, props string, refs string"
DAY = dt.datetime(2024, 1, 1)


def brute(rows: list[tuple]) -> set[tuple]:
    held: dict = {}
    for ds, no, at, i, p, r in rows:
        if None in (ds, no, i):
            continue
        i = i.replace("http://x.invalid/people/", "ns3:")
        held.setdefault(ds, {}).setdefault(no, {})[i] = canonical_content(p, r)
    out = set()
    for ds, by in held.items():
        nos = sorted(by)
        for a, b in zip(nos, nos[1:]):
            old, new = by[a], by[b]
            out |= {(ds, b, i, "added") for i in new.keys() - old.keys()} | {(ds, b, i, "removed") for i in old.keys() - new.keys()}
            out |= {(ds, b, i, "changed") for i in new.keys() & old.keys() if new[i] != old[i]}
    return out


@pytest.mark.parametrize("container", [8, 64, 1 << 14])
def test_random_deliveries(spark, namespaces, container):
    rng = random.Random(container)
    rows = []
    for ds in ("a", "b"):
        for no in (1, 2, 4, 7):
            for i in rng.sample(range(60), 40):
                name = f"http://x.invalid/people/{i}" if rng.random() < 0.2 else f"ns3:{i}"
                number = rng.choice(["1", "1.0", "1e0", "2"])
                rows.append((ds, no, DAY, name, f'{{"p": {number}, "q": [{i % 3}]}}', None if i % 2 else "{}"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert set_of(snapshot_changes(df, namespaces, container=container)) == brute(rows)


def test_what_counts_as_equal(spark, namespaces):
    pairs = [
        ('{"a":1,"b":2}', '{ "b":2.0, "a":1e0 }', True),
        ('{"a":null}', None, True),
        ('{"a":"\\u00e9"}', '{"a":"é"}', True),
        ('{"a":"é"}', '{"a":"e\\u0301"}', False),
        ('{"a":{"b":null}}', '{"a":{}}', False),
        ('{"a":"1"}', '{"a":1}', False),
        ('{"a":"x"}', '{"a":["x"]}', False),
        ('{"a":[1,2]}', '{"a":[2,1]}', False),
        ('{"a":[]}', "{}", False),
        ('{"a":true}', '{"a":1}', False),
        ('{"a":9007199254740993}', '{"a":9007199254740992}', False),
    ]
    rows = [("d", n, DAY, str(i), p[n - 1], "{}") for i, p in enumerate(pairs) for n in (1, 2)]
    changed = {r[2] for r in rows_of(snapshot_changes(spark.createDataFrame(rows, SCHEMA), namespaces))}
    assert changed == {str(i) for i, p in enumerate(pairs) if not p[2]}


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 16384])
def test_bitmaps_round_trip_and_stay_short(n):
    slots = np.sort(np.random.default_rng(n).choice(16384, n, replace=False))
    packed = compress(slots, 16384)
    assert np.nonzero(np.unpackbits(words(packed, 16384)))[0].tolist() == slots.tolist() and len(packed) <= min(2 * n, 2048) + 1
    assert not words(None, 16384).any()


def test_ordinals_persist(spark):
    keys = spark.createDataFrame([("d", f"k{i}") for i in range(100)], "dataset string, id string")
    known = assign_ordinals(keys, container=16)
    grown = assign_ordinals(spark.createDataFrame([("d", f"k{i}") for i in range(50, 150)] + [("e", "k1")], "dataset string, id string"), known, container=16)
    old = {(r.dataset, r.id): (r.shard, r.ordinal) for r in known.collect()}
    new = {(r.dataset, r.id): (r.shard, r.ordinal) for r in grown.collect()}
    assert all(new[k] == v for k, v in old.items()) and len(new) == 151
    places = [(d, s, o) for (d, _), (s, o) in new.items()]
    assert len(set(places)) == len(places)


def test_odd_rows(spark, namespaces):
    rows = [
        (None, 1, DAY, "x", "{}", "{}"),
        ("d", None, DAY, "x", "{}", "{}"),
        ("d", 1, DAY, None, "{}", "{}"),
        ("d", 1, None, "x", "not json", None),
        ("d", 2, DAY, "x", "not json", None),
        ("d", 2, DAY, "y", '{"a": "' + "z" * 200_000 + '"}', "{}"),
        ("d", 2, DAY, "y", '{"a": "' + "z" * 200_000 + '"}', "{}"),
        ("d", 3, DAY, "x", "not json!", None),
        ("d", 3, None, "y", "{}", "{}"),
        ("d", 3, DAY, "y", '{"b": 1}', "{}"),
        ("only", 5, DAY, "x", "{}", "{}"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"mark": F.lit(1), "shard": F.lit("s"), "role": F.lit(2), "slot": F.lit(3), "ordinal": F.lit(4)})
    assert set_of(snapshot_changes(df, namespaces)) == {("d", 2, "y", "added"), ("d", 3, "x", "changed"), ("d", 3, "y", "changed")}


def test_empty(spark, namespaces):
    assert rows_of(snapshot_changes(spark.createDataFrame([], SCHEMA), namespaces)) == []


def test_an_index_grows_with_its_deliveries(spark, namespaces, tmp_path):
    """Two runs over growing deliveries: the first one's ordinals stay, and no shard passes two containers."""
    rng = random.Random(1)
    rows = [("d", no, DAY, f"ns3:{i}", f'{{"p": {rng.randint(0, 2)}}}', "{}") for no, n in ((1, 20), (2, 25), (3, 400), (4, 405)) for i in range(n)]
    frame = lambda top: spark.createDataFrame([r for r in rows if r[1] <= top], SCHEMA)
    first = OrdinalIndex(spark, str(tmp_path / "index"))
    assert set_of(snapshot_changes(frame(2), namespaces, first, 32)) == brute([r for r in rows if r[1] <= 2])
    old = {(r.dataset, r.id): (r.shard, r.ordinal) for r in first.ordinals().collect()}
    again = OrdinalIndex(spark, str(tmp_path / "index"))
    assert set_of(snapshot_changes(frame(4), namespaces, again, 32)) == brute(rows)
    new = {(r.dataset, r.id): (r.shard, r.ordinal) for r in again.ordinals().collect()}
    assert len(old) == 25 and len(new) == 405 == len(set(new.values())) and all(new[k] == v for k, v in old.items())
    sizes = {}
    for shard, _ in new.values():
        sizes[shard] = sizes.get(shard, 0) + 1
    assert len(sizes) >= 12 and max(sizes.values()) <= 64
    snapshot_changes(frame(4), namespaces, again, 32)
    assert len(again._files.get("index")["parts"]) == 2  # nothing new, no new part
    with pytest.raises(ValueError, match="containers"):
        again.extend(frame(1), 64)
