import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from strandlog.operators.orphans import _sliced, events_of, orphans, orphans_by_period

from .conftest import rows_of, set_of

SCHEMA = "dataset string, seq bigint, id string, recorded bigint, batch_seq int, deleted boolean, props string, refs string"
BASE = 1_700_000_000_000_000_000


def brute(rows: list[tuple]) -> set[tuple]:
    vers: dict[str, list] = {}
    for ds, _, i, rec, b, dele, _, _ in rows:
        if None not in (ds, i, rec):
            vers.setdefault(i, []).append((ds, rec, -1 if b is None else b, bool(dele)))
    out = set()
    for ds, seq, _, rec, _, dele, _, refs in rows:
        if None in (ds, seq, rec) or dele or not refs:
            continue
        for p, v in json.loads(refs).items():
            for target in v if isinstance(v, list) else [v]:
                if not isinstance(target, str):
                    continue
                all_ = vers.get(target, [])
                then = [x for x in all_ if x[1] <= rec]
                if not all_:
                    reason = "missing"
                elif not then:
                    reason = "late"
                else:
                    last = {}
                    for d, r, b, g in sorted(then, key=lambda x: (x[1], x[2], not x[3])):
                        last.setdefault(d, []).append((r, b, g))
                    gone = [min((g for r, b, g in v if (r, b) == max((r, b) for r, b, _ in v)), default=True) for v in last.values()]
                    reason = "deleted" if all(gone) else None
                if reason:
                    month = dt.datetime.fromtimestamp(rec // 10**9, dt.UTC).strftime("%Y-%m")
                    out.add((ds, month, seq, p, target, reason))
    return out


def history(seed: int, n: int, hot: float) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        i = "ns3:hot" if rng.random() < hot else f"ns3:{rng.randrange(30)}"
        names = ["ns3:hot" if rng.random() < hot else f"ns3:{rng.randrange(40)}" for _ in range(rng.randrange(4))]
        refs = {"p": names, "q": rng.choice(names) if names else None}
        rows.append((rng.choice("abc"), seq, i, BASE + rng.randrange(40) * 10**15, rng.randrange(3), rng.choice([True, False, None, True]), None, json.dumps(refs)))
    return rows


@pytest.mark.parametrize(("seed", "hot", "slices"), [(1, 0.0, 50_000), (2, 0.5, 20), (3, 0.9, 5), (4, 0.3, 50_000)])
def test_random_histories(spark, namespaces, seed, hot, slices):
    rows = history(seed, 250, hot)
    # several rows may share (dataset, recorded, batch_seq); a live one then counts
    assert set_of(orphans(spark.createDataFrame(rows, SCHEMA), namespaces, hot_events=slices)) == brute(rows)


def test_spelling_and_repeats(spark, namespaces):
    rows = [
        ("a", 1, "http://x.invalid/people/1", BASE, 0, None, None, '{"p": ["ns3:9", "http://x.invalid/people/9", "ns3:1"]}'),
        ("a", 1, "http://x.invalid/people/1", BASE, 0, None, None, '{"p": ["ns3:9", "http://x.invalid/people/9", "ns3:1"]}'),
        ("a", 2, "ns3:2", BASE + 1, 0, False, None, '{"p": "http://unknown.invalid/7", "http://x.invalid/people/q": "x"}'),
    ]
    assert set_of(orphans(spark.createDataFrame(rows, SCHEMA), namespaces)) == {
        ("a", "2023-11", 1, "p", "ns3:9", "missing"),
        ("a", "2023-11", 2, "p", "http://unknown.invalid/7", "missing"),
        ("a", "2023-11", 2, "ns3:q", "x", "missing"),
    }


def test_odd_rows(spark, namespaces):
    long = "y" * 100_000
    rows = [
        (None, 1, "ns3:1", BASE, 0, None, None, '{"p": "gone"}'),
        ("a", None, "ns3:1", BASE, 0, None, None, '{"p": "gone"}'),
        ("a", 2, "ns3:1", None, 0, None, None, '{"p": "gone"}'),
        ("a", 3, None, BASE, None, None, None, json.dumps({"p": long, "e": "", "n": None, "l": [], "x": 3, "o": {"a": "b"}, "m": [None, 1, ["z"]]})),
        ("a", 4, "ns3:1", BASE, 0, None, None, "broken {"),
        ("a", 5, "ns3:1", BASE, 0, None, None, "[1]"),
        ("a", 6, "ns3:1", BASE, 0, True, None, '{"p": "gone"}'),
        ("a", 7, "ns3:1", BASE, 0, None, None, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"kind": F.lit("k"), "slice": F.lit("s"), "live": F.lit(1), "target": F.lit(2), "known": F.lit(3)})
    assert set_of(orphans(df, namespaces)) == {("a", "2023-11", 3, "p", long, "missing"), ("a", "2023-11", 3, "e", "", "missing")}


def test_empty_and_report(spark, namespaces):
    empty = orphans(spark.createDataFrame([], SCHEMA), namespaces)
    assert rows_of(empty) == [] and rows_of(orphans_by_period(empty)) == []


def test_a_hot_id_at_one_instant_is_spread(spark, namespaces):
    """All versions and references of one id at one time, where no time slice can cut."""
    rows = [("ab"[n % 2], n, "ns3:hot", BASE, n % 3, n % 5 == 0, None, None) for n in range(150)]
    rows += [("c", n, f"ns3:{n}", BASE, 0, False, None, '{"p": "ns3:hot", "q": "ns3:none"}') for n in range(300)]
    rows += [("c", 900, "ns3:9", BASE - 5, 0, False, None, '{"p": "ns3:hot"}'), ("c", 901, "ns3:9", BASE + 10**15, 0, False, None, '{"p": "ns3:hot"}')]
    df = spark.createDataFrame(rows, SCHEMA)
    assert set_of(orphans(df, namespaces, hot_events=20)) == brute(rows)
    placed = _sliced(events_of(df, namespaces), 20)
    shares = [r["count"] for r in placed.where("id IN ('ns3:hot', 'ns3:none')").groupBy("id", "slice", "salt").count().collect()]
    assert len(shares) > 20 and max(shares) <= 60
