import json

import pytest

from strandlog.functions.uri import PrefixTable
from strandlog.operators import snapshot
from strandlog.store import Conflict, EntityStore, Gone

ROWS = "entity_id string, deleted boolean, props string, refs string, pos bigint"


@pytest.fixture
def store(spark, tmp_path):
    s = EntityStore(spark, str(tmp_path / "store"))
    s.create_dataset("people")
    return s


def frame(spark, *rows):
    return spark.createDataFrame([(i, d, p, r, n) for n, (i, d, p, r) in enumerate(rows)], ROWS)


def ids(spark, *names, **props):
    return frame(spark, *[(str(n), False, json.dumps(props), "{}") for n in names])


def test_equal_versions_are_not_stored(spark, store):
    assert store.store_entities("people", ids(spark, 1, 2, 3)) == 3
    assert store.store_entities("people", ids(spark, 1, 2, 3)) == 0
    assert store.store_entities("people", ids(spark, 3, 4, v=1)) == 2
    assert [r.seq for r in store.feed("people").collect()] == [0, 1, 2, 3, 4]
    assert [(r.entity_id, r.props) for r in store.entities("people").orderBy("entity_id").collect()] == [("1", "{}"), ("2", "{}"), ("3", '{"v": 1}'), ("4", '{"v": 1}')]


def test_repeats_within_a_batch(spark, store):
    a, b = ("e", False, '{"v":1}', "{}"), ("e", False, '{"v":2}', "{}")
    assert store.store_entities("people", frame(spark, a, a)) == 2  # a new entity is stored as often as it comes
    assert store.store_entities("people", frame(spark, a, b, a)) == 2  # back to the stored state: differs from the row before
    assert store.store_entities("people", frame(spark, a, a, a)) == 0
    store.create_dataset("strict")
    assert store.store_entities("strict", frame(spark, a, a, b, b, a), strict=True) == 3
    assert store.entities("people").first().props == '{"v":1}'  # the last of a batch wins


def test_full_syncs(spark, store):
    """Deliveries that overlap, then one that lacks some: 20 changes, then deletions only."""
    for a, z in ((1, 10), (5, 15), (10, 20)):
        store.store_entities("people", ids(spark, *range(a, z + 1)))
    assert store.changes().count() == 20
    store.store_entities("people", frame(spark, ("7", True, "{}", "{}"), ("8", True, "{}", "{}")))
    assert store.changes().count() == 22 and store.entities("people").count() == 20
    store.full_sync("people", ids(spark, *range(4, 17)))
    gone = {r.entity_id for r in store.entities("people").where("deleted").collect()}
    assert gone == {"1", "2", "3", "17", "18", "19", "20"}
    assert store.full_sync("people", ids(spark, *range(4, 17))) == 0


def test_full_sync_leases(spark, store):
    store.start_full_sync("people", "s1")
    with pytest.raises(Conflict):
        store.store_entities("people", ids(spark, 1))
    store.store_entities("people", ids(spark, 1), sync_id="s1")
    with pytest.raises(Conflict):
        store.end_full_sync("people", "s2", ids(spark, 1))
    assert store.end_full_sync("people", "s1", ids(spark, 1)) == 0
    with pytest.raises(Gone):
        store.end_full_sync("people", "s1", ids(spark, 1))
    store.lease_seconds = -1
    store.start_full_sync("people", "s3")
    assert store.store_entities("people", ids(spark, 2)) == 1  # a lease that ran out excludes nothing


def test_transactions_are_atomic(spark, store):
    store.create_dataset("companies")
    rows = frame(spark, ("p", False, "{}", "{}"), ("c", False, "{}", "{}")).selectExpr("if(entity_id = 'p', 'people', 'companies') dataset", "*")
    assert store.transaction(rows) == 2
    assert len({r.recorded for r in store.changes().collect()}) == 1
    with pytest.raises(ValueError, match="no such dataset"):
        store.transaction(rows.selectExpr("if(entity_id = 'p', 'people', 'nowhere') dataset", "entity_id", "true deleted", "props", "refs", "pos"))
    assert store.changes().count() == 2


def test_rows_of_an_unfinished_write_are_never_read(spark, store, tmp_path):
    store.store_entities("people", ids(spark, 1))
    ids(spark, 9).selectExpr("'people#1' dataset", "0L seq", "entity_id", "1L recorded", "0 batch_seq", "deleted", "props", "refs").write.parquet(str(tmp_path / "store" / "batch-torn"))
    again = EntityStore(spark, str(tmp_path / "store"))
    assert [r.entity_id for r in again.changes().collect()] == ["1"]


def test_datasets(spark, store):
    assert store.create_dataset("people") == 1 and store.create_dataset("a") == 2 and store.dataset_names() == ["a", "people"]
    store.store_entities("people", ids(spark, 1, 2))
    store.rename_dataset("people", "persons")
    assert {r.dataset for r in store.changes().collect()} == {"persons"}
    assert {(r.dataset, r.items) for r in store.dataset_entities().collect()} == {("a", 0), ("persons", 2)}
    store.delete_dataset("persons")
    assert store.changes().count() == 0
    assert store.create_dataset("persons") == 3 and store.changes().count() == 0  # a new dataset of an old name is empty
    store.store_entities("persons", ids(spark, 5))
    store.collect_garbage()
    assert [r.entity_id for r in store.changes().collect()] == ["5"]
    with pytest.raises(ValueError, match="url"):
        store.create_dataset("remote", "proxy")
    store.create_dataset("remote", "proxy", url="http://r.invalid")
    assert store.proxy_url("remote") == "http://r.invalid" and store.proxy_url("persons") is None
    with pytest.raises(ValueError, match="exists"):
        store.rename_dataset("persons", "a")


def test_compaction_of_the_store(spark, store):
    a, b = ("e", False, '{"v":1}', "{}"), ("e", False, '{"v":2}', "{}")
    store.store_entities("people", frame(spark, a, a, a))
    store.store_entities("people", frame(spark, b))
    before = [(r.entity_id, r.props) for r in store.entities("people").collect()]
    store.compact()
    assert store.changes().count() == 2 and [(r.entity_id, r.props) for r in store.entities("people").collect()] == before
    assert store.store_entities("people", frame(spark, a)) == 1
    assert snapshot.next_offset(store.feed("people"), 0) == 5  # offsets go on


def test_namespaces_and_content(spark, store, tmp_path):
    table = store.prefixes()
    table.assert_prefix("http://a.invalid/")
    store.save_prefixes(table)
    store.create_dataset("public", public_namespaces=["http://b.invalid/"])
    store.put_content("c", {"x": 1})
    again = EntityStore(spark, str(tmp_path / "store"))
    assert isinstance(again.prefixes(), PrefixTable) and again.context()["namespaces"] == {"ns0": "http://a.invalid/"} and again.context("public")["namespaces"] == {}
    assert again.get_content("c") == {"x": 1}
    again.put_content("c", None)
    assert again.get_content("c") is None


def test_odd_rows(spark, store):
    rows = spark.createDataFrame([(None, False, "{}", "{}", 1), ("", None, None, None, 2), ("long", False, '{"t":"' + "x" * 200_000 + '"}', "not json", 3)], ROWS)
    assert store.store_entities("people", rows) == 2
    assert store.store_entities("people", rows) == 0
    assert store.store_entities("people", spark.createDataFrame([], ROWS)) == 0


def folders(tmp_path):
    return sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("batch="))


def test_a_small_write_reads_only_what_it_touches(spark, store, monkeypatch):
    monkeypatch.setattr("strandlog.store.BUCKET_ROWS", 10)
    store.create_dataset("other")
    store.store_entities("people", ids(spark, *range(160)))
    store.store_entities("other", ids(spark, *range(160)))
    assert [b["buckets"] for b in store._meta["batches"]] == [16, 16]
    read = []
    inner = store._touched
    monkeypatch.setattr(store, "_touched", lambda *given: read.append(inner(*given)) or read[0])
    assert store.store_entities("people", ids(spark, 7, 8, v=1)) == 2
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = read[0].select("*")
        assert {r.entity_id for r in rows.collect()} == {"7", "8"}
        leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]
    assert sum(s.metrics().apply("numFiles").value() for s in scans) <= 2  # of 32
    assert scans and not any("props" in s.requiredSchema().simpleString() for s in scans)


def test_files_out_of_use_are_deleted(spark, store, tmp_path):
    store.create_dataset("gone")
    store.store_entities("people", ids(spark, 1))
    store.store_entities("gone", ids(spark, 1))
    store.transaction(ids(spark, 2).selectExpr("'people' dataset", "*").unionByName(ids(spark, 2).selectExpr("'gone' dataset", "*")))
    store.compact()
    store.compact()
    (tmp_path / "store" / "batch=torn").mkdir()
    assert len(folders(tmp_path)) == 6 and len(store._meta["batches"]) == 1  # the old ones have their grace
    store.delete_dataset("gone")
    assert store.collect_garbage() == 0
    assert store.sweep(0) == 6 and folders(tmp_path) == [f"batch={store._meta['batches'][0]['name']}"]
    assert {p.name for p in (tmp_path / "store" / folders(tmp_path)[0]).iterdir() if p.name.startswith("ds=")} == {"ds=people%231"}
    again = EntityStore(spark, str(tmp_path / "store"))
    assert sorted(r.entity_id for r in again.changes().collect()) == ["1", "2"] and again.sweep(0) == 0


def test_small_batches_are_merged(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr("strandlog.store.MERGE", 3)
    for i in range(9):
        assert store.store_entities("people", ids(spark, i)) == 1
    assert len(store._meta["batches"]) == 1
    rows = store.feed("people").collect()
    assert [(r.seq, r.entity_id) for r in rows] == [(i, str(i)) for i in range(9)] and store.store_entities("people", ids(spark, *range(9))) == 0


def test_renamed_datasets_keep_their_rows_apart(spark, store):
    store.store_entities("people", ids(spark, 1))
    store.rename_dataset("people", "odd#name")
    store.create_dataset("people")
    store.store_entities("people", ids(spark, 2))
    assert {(r.dataset, r.entity_id) for r in store.changes().collect()} == {("odd#name", "1"), ("people", "2")}
    assert store.store_entities("odd#name", ids(spark, 1)) == 0 and store.feed("odd#name").count() == 1


def test_more_datasets_than_an_expression_names(spark, store, monkeypatch):
    monkeypatch.setattr("strandlog.store.INLINE_DATASETS", 1)
    store.create_dataset("b")
    store.create_dataset("c")
    store.rename_dataset("b", "b2")
    store.rename_dataset("c", "c2")
    for n in ("people", "b2", "c2"):
        store.store_entities(n, ids(spark, n))
    assert {(r.dataset, r.entity_id) for r in store.changes().collect()} == {("people", "people"), ("b2", "b2"), ("c2", "c2")}


def test_writes_are_the_same_at_every_size(spark, store, monkeypatch):
    """The ways of ordering few and many rows give the same versions."""
    rows = [(str(i % 7), i % 11 == 0, f'{{"v":{i // 9 % 3}}}', "{}") for i in range(60)]
    store.create_dataset("many")
    got = []
    for name, most in (("people", 100_000), ("many", 0)):
        monkeypatch.setattr("strandlog.ordering.SMALL_ROWS", most)
        monkeypatch.setattr("strandlog.operators.mutation.SMALL_ROWS", most)
        store.store_entities(name, frame(spark, *rows[:30]))
        store.store_entities(name, frame(spark, *rows[30:]))
        got.append([(r.seq, r.entity_id, r.deleted, r.props, r.batch_seq) for r in store.feed(name).collect()])
    assert got[0] == got[1] and len(got[0]) > 30
