import json

import pytest

from strandlog.model import SCHEMA
from strandlog.operators import graph, maintenance, snapshot

from .conftest import rows_of, set_of

FRIEND, FAMILY = "p:Friend", "p:Family"


class History:
    """Writes batches of persons to datasets; a later batch has a later time."""

    def __init__(self, spark):
        self.spark, self.rows, self.at, self.seq = spark, [], 0, {}

    def batch(self, dataset, *persons):
        self.at += 10
        for n, person in enumerate(persons):
            i, friends, *rest = person
            family = rest[0] if rest and isinstance(rest[0], list) else []
            refs = {k: [f"p:{x}" for x in v] for k, v in ((FRIEND, friends), (FAMILY, family)) if v}
            seq = self.seq[dataset] = self.seq.get(dataset, -1) + 1
            self.rows.append((dataset, seq, f"p:{i}", self.at, n, "del" in rest, json.dumps({"p:Name": f"Person {i}"}), json.dumps(refs)))
        return self

    def log(self):
        return self.spark.createDataFrame(self.rows, SCHEMA)

    def out(self, *ids, predicate="*", inverse=False, datasets=None, at=None):
        starts = self.spark.createDataFrame([(f"p:{i}",) for i in ids], "start_id string")
        return graph.hop(starts, graph.relations(self.log(), at=at), predicate, inverse, datasets)

    def found(self, *ids, **options):
        return sorted((r.start_id[2:], r.predicate[2:], r.related_id[2:]) for r in self.out(*ids, **options).collect())


@pytest.fixture
def h(spark):
    return History(spark)


def test_batch_with_several_versions(h):
    h.batch("a", (1, [0]), (2, [1, 4]), (3, [2], "del"), (0, [1, 2, 3, 4]), (3, [2]), (0, [1], "del"), (1, [3, 2, 4]))
    assert {r[2] for r in h.found(1)} == {"2", "3", "4"}
    assert len(h.found(1, 2)) == 5
    assert len(h.found(1, 2, inverse=True)) == 3
    assert h.found(99) == []


def test_pages_go_on_where_they_ended(h):
    h.batch("a", (1, list(range(2, 11)))).batch("a", (2, list(range(11, 21))))
    hops, seen, after = h.out(1, 2), [], None
    while page := graph.page_hop(hops, 4, after).collect():
        seen += [(r.start_id, r.related_id) for r in page]
        last = page[-1]
        after = (last.start_id, last.recorded, last.predicate, last.related_id)
    assert len(seen) == len(set(seen)) == 19


def test_star_over_several_predicates(h):
    h.batch("a", (1, [2, 3])).batch("a", (1, [2, 3], [4])).batch("a", (1, [2, 3, 4], [5]))
    assert h.found(1) == [("1", "Family", "5"), ("1", "Friend", "2"), ("1", "Friend", "3"), ("1", "Friend", "4")]
    assert h.found(1, predicate=FRIEND) == h.found(1)[1:] and h.found(1, predicate="p:None") == []


@pytest.mark.parametrize(("states", "n"), [("DL", 1), ("DLDL", 1), ("LD", 0), ("LDLD", 0), ("L", 1), ("D", 0)])
@pytest.mark.parametrize("same_batch", [True, False])
def test_alternating_deletes(h, states, n, same_batch):
    versions = [(1, [2], "del") if s == "D" else (1, [2]) for s in states]
    if same_batch:
        h.batch("a", *versions)
    else:
        for v in versions:
            h.batch("a", v)
    assert len(h.found(1)) == len(h.found(2, inverse=True)) == n


@pytest.mark.parametrize("deleted", [(), ("a",), ("b",), ("a", "b"), ("a", "b", "c")])
def test_link_in_several_datasets(h, deleted):
    for ds in "abcd":
        h.batch(ds, (1, [2]), (2, []))
    for ds in deleted:
        h.batch(ds, (1, [2], "del"))
    assert h.found(1) == [("1", "Friend", "2")]
    assert h.found(2, inverse=True) == [("2", "Friend", "1")]
    assert h.found(1, datasets=list(deleted)) == [] or not deleted
    if deleted:
        for ds in set("abcd") - set(deleted):
            h.batch(ds, (1, [2], "del"))
        assert h.found(1) == []


def test_removed_predicate_is_gone_everywhere(h):
    h.batch("people", (1, [1])).batch("family", (1, [1])).batch("people", (1, [], [1]))
    assert len(h.found(1, inverse=True)) == 2
    h.batch("people", (1, [])).batch("family", (1, [])).batch("people", (1, [1])).batch("family", (1, [1]))
    assert h.found(1, inverse=True) == [("1", "Friend", "1")]
    h.batch("people", (1, []))
    assert h.found(1, datasets=["people"]) == [] and len(h.found(1, datasets=["family"])) == 1


def test_self_link_of_a_deleted_subject(h):
    h.batch("a", (1, [1]), (2, [1])).batch("a", (1, [1], "del"))
    assert h.found(1, inverse=True) == [("1", "Friend", "2")]


def test_points_in_time(h):
    for i, deleted in enumerate([False, False, True, True, True, False, False]):
        h.batch("a", (1, [2, 3], "del") if deleted else (1, [2, 3], [i + 10]))
    for batch, live in enumerate([False, True, True, False, False, False, True, True]):
        at = batch * 10
        assert (len(h.found(1, predicate=FRIEND, at=at)), len(h.found(3, predicate=FRIEND, inverse=True, at=at))) == ((2, 1) if live else (0, 0))


CATALOG = [("a", 1), ("b", 2), ("c", 3)]


def merged(spark, parts):
    """Parts are (dataset, name or None, other, deleted)."""
    rows = [(ds, 0, "homer", 5, 0, d, json.dumps({k: v for k, v in (("name", n), ("dob", o)) if v is not None}), "{}") for ds, n, o, d in parts]
    catalog = spark.createDataFrame(CATALOG, "dataset string, dataset_id int")
    p = graph.partials(snapshot.latest(spark.createDataFrame(rows, SCHEMA)), catalog)
    return p, graph.merged_entities(p).first()


@pytest.mark.parametrize(
    ("names", "value"),
    [(["homer", "bob"], ["homer", "bob"]), ([["homer", "brian"], "bob"], ["homer", "brian", "bob"]), (["bob", ["homer", "brian"]], ["bob", "homer", "brian"]), ([["x"], ["y", "x"]], ["x", "y", "x"]), (["same", "same"], ["same", "same"]), (["one", None], "one"), ([["one"], None], ["one"]), ([[], "x"], ["x"]), ([1, 2.5], [1, 2.5])],
)
def test_merging_values(spark, names, value):
    _, row = merged(spark, [("b" if i else "a", n, None, False) for i, n in enumerate(names)])
    assert json.loads(row.props["name"]) == value


def test_merging_three_parts_in_dataset_order(spark):
    _, row = merged(spark, [("c", "james", None, False), ("a", "bob", None, False), ("b", "brian", "1970", False)])
    assert json.loads(row.props["name"]) == ["bob", "brian", "james"] and json.loads(row.props["dob"]) == "1970" and row.n_partials == 3


def test_deleted_parts(spark):
    parts, row = merged(spark, [("a", "gone", None, True), ("b", "here", None, False)])
    assert row.deleted is False and json.loads(row.props["name"]) == "here"
    assert [r.dataset for r in graph.multi_origin(parts).collect()] == ["b"]
    parts, row = merged(spark, [("a", "gone", None, True), ("b", "too", None, True)])
    assert row.deleted is True and row.props is None and row.n_partials == 0
    assert [(r.position, r.dataset) for r in graph.multi_origin(parts).orderBy("position").collect()] == [(0, "a"), (1, "b")]


def test_lookup_and_placeholders(spark):
    rows = [("a", 0, "x", 5, 0, False, '{"n":1}', '{"r":["y","z"]}'), ("b", 0, "y", 6, 0, False, "{}", "{}"), ("c", 0, "x", 7, 0, False, '{"n":2}', "{}")]
    log, catalog = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(CATALOG, "dataset string, dataset_id int")
    found = {r.entity_id: r for r in graph.lookup(log, catalog, ["x", "none"]).collect()}
    assert found["x"].props == {"n": "[1,2]"} and found["none"].props is None
    assert graph.lookup(log, catalog, ["x"], datasets=["c"]).first().props == {"n": "2"}
    assert graph.lookup(log, catalog, ["x"], at=5).first().props == {"n": "1"}
    entities = graph.merged_entities(graph.partials(snapshot.latest(log), catalog))
    hops = graph.hop(spark.createDataFrame([("x",)], "start_id string"), graph.relations(log))
    assert {(r.related_id, r.entity_recorded, r.resolved) for r in graph.hydrate(hops, entities).collect()} == {("y", 6, True), ("z", 0, False)}
    assert set_of(graph.entity_details(log, ["x"])) == {("x", "a", 0, 5, 1), ("x", "c", 0, 7, 1)}
    assert [r.dataset for r in graph.entity_history(log, ["x"]).collect()] == ["a", "c"]


def test_scope(spark):
    log = spark.createDataFrame([("people", 0, "x", 5, 0, False, "{}", "{}"), ("dropped", 0, "x", 5, 0, False, "{}", "{}")], SCHEMA)
    catalog = spark.createDataFrame([("people", False), ("dropped", True), ("empty", False)], "dataset string, deleted boolean")
    scope = lambda ds: sorted(r.dataset for r in snapshot.in_scope(log, catalog, ds).collect())
    assert scope(None) == scope([]) == scope(["bogus"]) == scope(["people", "bogus"]) == ["people"] and scope(["empty"]) == []


def test_closure_with_loops(spark):
    links = spark.createDataFrame([("d", f"n{i}", "p", f"n{i + 1}", 0) for i in range(20)] + [("d", "n20", "p", "n15", 0), ("d", "n0", "q", "x", 0)], "dataset string, subject string, predicate string, object string, recorded bigint")
    want = {(f"n{i}", f"n{j}") for i in range(21) for j in range(21) if j > i or (i >= 15 and j >= 15)}
    assert set_of(graph.closure(links, "p")) == want


def test_feeds_and_tokens(spark):
    rows = [("d", i, f"e{i % 3}", i, 0, False, "{}", "{}") for i in range(10)] + [("other", 0, "e0", 1, 0, False, "{}", "{}")]
    log = spark.createDataFrame(rows, SCHEMA)
    seqs = lambda **o: [r.seq for r in snapshot.feed(log, "d", **o).collect()]
    assert seqs() == list(range(10)) and seqs(since=4, limit=3) == [4, 5, 6] and seqs(since=99) == []
    assert seqs(only_latest=True) == [7, 8, 9] and seqs(only_latest=True, limit=2) == [7, 8]
    assert seqs(reverse=True, limit=2) == [9, 8] and seqs(reverse=True, since=3) == [3, 2, 1, 0] and seqs(reverse=True, only_latest=True) == [9, 8, 7]
    assert snapshot.next_offset(snapshot.feed(log, "d", 4, 3), 4) == 7 and snapshot.next_offset(snapshot.feed(log, "d", 99), 99) == 99
    assert set_of(snapshot.watermark(log)) == {("d", 10), ("other", 1)}
    entities = snapshot.latest(log.where("dataset = 'd'"))
    assert [r.entity_id for r in snapshot.entity_page(entities, None, 2).collect()] == ["e0", "e1"] and [r.entity_id for r in snapshot.entity_page(entities, "e1").collect()] == ["e2"]
    for v in (5, "key", {"a": 1}):
        assert snapshot.decode_token(snapshot.encode_token(v)) in (str(v), json.dumps(v))
    assert snapshot.decode_token("") == snapshot.decode_token(None) == ""


def test_compaction_keeps_every_lookup(spark):
    values = "AABBBACCAA"
    rows = [("d", i, "e", i * 10, 0, v == "C", json.dumps({"v": v}), '{"r":["x"]}') for i, v in enumerate(values)] + [("d", 90, "once", 5, 0, False, "{}", "{}")]
    log = spark.createDataFrame(rows, SCHEMA)
    small = maintenance.compact(log)
    assert sorted(r.seq for r in small.collect()) == [0, 2, 5, 6, 8, 90]
    for at in range(0, 100, 10):
        state = lambda df: sorted((r.entity_id, r.deleted, r.props, r.refs) for r in snapshot.latest(df, at).collect())  # noqa: E731, B023
        assert state(log) == state(small)
    assert rows_of(maintenance.compact(spark.createDataFrame([], SCHEMA))) == []


def test_lineage(spark):
    jobs = [(["a", "b"], ["c"], False, [], []), (["c"], ["d"], True, ["x"], ["t"]), (["a"], ["c"], False, None, None), (None, ["z"], True, ["y"], [])]
    df = spark.createDataFrame(jobs, "sources array<string>, sinks array<string>, transforms boolean, hops array<string>, transactions array<string>")
    assert rows_of(maintenance.lineage(df)) == [("a", "c", "copy"), ("b", "c", "copy"), ("c", "d", "transform"), ("c", "t", "transform-hop"), ("x", "d", "transform-hop"), ("y", "z", "transform-hop")]
    assert rows_of(maintenance.lineage(df, "b")) == [("b", "c", "copy")]


def test_statistics(spark):
    log = spark.createDataFrame([("d", 0, "é", 1, 0, False, "{}", "{}"), ("d", 1, "x", 2, 0, True, "{}", "{}")], SCHEMA)
    assert set_of(maintenance.statistics(log)) == {("d", False, 1, 3, 4), ("d", True, 1, 2, 4), ("d", None, 2, 5, 8), (None, None, 2, 5, 8)}


def test_closure_says_when_it_is_not_whole(spark):
    links = spark.createDataFrame([(str(i), "p", str(i + 1)) for i in range(12)], "subject string, predicate string, object string")
    assert graph.closure(links, "p").count() == 78
    with pytest.raises(ValueError, match="rounds"):
        graph.closure(links, "p", max_rounds=2)
