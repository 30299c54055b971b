import json

import pytest
from pyspark.sql import functions as F

from strandlog.api import Hub
from strandlog.functions.access import Rule
from strandlog.functions.diagnostics import Timings, log
from strandlog.model import SCHEMA
from strandlog.operators import graph, maintenance, snapshot
from strandlog.plans.pipeline import EventBus
from strandlog.plans.query import Query, paged_query, run_query
from strandlog.store import Conflict, Gone

from .conftest import set_of

CONTEXT = {"id": "@context", "namespaces": {"p": "http://p.invalid/", "c": "http://c.invalid/"}}


def doc(*entities):
    return json.dumps([CONTEXT, *entities])


@pytest.fixture
def hub(spark, tmp_path):
    h = Hub(spark, str(tmp_path))
    h.create_dataset("people")
    h.create_dataset("companies")
    return h


def test_documents_in_and_out(hub):
    n = hub.post_entities("people", doc({"id": "p:1", "props": {"p:name": "A", "p:box": {"id": "p:b", "props": {"p:x": 1}}}, "refs": {"p:works": "c:1", "p:knows": ["p:2", "http://other.invalid/3"]}}, {"id": "p:2", "deleted": True}))
    assert n == 2 and hub.namespaces() == {"ns0": "http://p.invalid/", "ns1": "http://other.invalid/", "ns2": "http://c.invalid/"}
    one = hub.entities("people", limit=1).first()
    assert one.entity_id == "ns0:1" and json.loads(one.refs) == {"ns0:works": "ns2:1", "ns0:knows": ["ns0:2", "ns1:3"]} and json.loads(one.props)["ns0:box"]["props"] == {"ns0:x": 1}
    rows, token = hub.changes("people", limit=1)
    assert rows.count() == 1
    rows, token = hub.changes("people", token)
    assert [r.entity_id for r in rows.collect()] == ["ns0:2"] and hub.changes("people", token)[0].count() == 0
    assert [r.entity_id for r in hub.changes("people", reverse=True, limit=1)[0].collect()] == ["ns0:2"]
    parsed = json.loads("".join(hub.document("people", hub.entities("people"), "t")))
    assert parsed[0]["namespaces"] == hub.namespaces() and [e["id"] for e in parsed[1:]] == ["ns0:1", "ns0:2", "@continuation"]
    assert json.loads("".join(hub.document("people", hub.entities("people"), "t", jsonld=True)))[1]["ns0:works"] == {"@id": "ns2:1"}
    assert hub.post_entities("people", doc({"id": "p:2", "deleted": True})) == 0


def test_full_sync_by_requests(hub):
    hub.post_entities("people", doc(*[{"id": f"p:{i}"} for i in range(5)]))
    hub.post_entities("people", doc({"id": "p:0"}), "s", start=True)
    with pytest.raises(Conflict):
        hub.post_entities("people", doc({"id": "p:9"}))
    with pytest.raises(Conflict):
        hub.post_entities("people", doc({"id": "p:9"}), "other")
    assert hub.post_entities("people", doc({"id": "p:1"}), "s", end=True) == 3
    with pytest.raises(Gone):
        hub.post_entities("people", doc({"id": "p:1"}), "s")
    assert sorted(r.entity_id for r in hub.entities("people").where("deleted").collect()) == ["ns0:2", "ns0:3", "ns0:4"]


def test_transactions_and_queries(hub):
    hub.post_transaction(json.dumps({"@context": CONTEXT, "people": [{"id": f"p:{i}", "refs": {"p:works": "c:1"}} for i in range(5)], "companies": [{"id": "c:1", "props": {"c:name": "X"}}]}))
    works = "ns0:works"
    result = hub.query({"startingEntities": ["ns0:1"], "predicate": works})
    row = result.rows.first()
    assert (row.related_id, json.loads(row.props["ns1:name"])) == ("ns1:1", "X") and result.continuation is None
    seen, body = [], {"startingEntities": ["ns1:1"], "predicate": works, "inverse": True, "limit": 2}
    while True:
        result = hub.query(body)
        seen += [r.related_id for r in result.rows.collect()]
        if result.continuation is None:
            break
        body = {"continuations": [result.continuation]}
    assert sorted(seen) == [f"ns0:{i}" for i in range(5)]
    assert hub.query({"startingEntities": ["ns0:1"], "predicate": "*", "datasets": ["companies"]}).rows.count() == 0
    assert hub.query({"startingEntities": ["ns0:1"], "predicate": "*", "datasets": ["bogus"]}).rows.count() == 1
    assert hub.query({"entityId": "ns1:1"}).rows.first().props == {"ns1:name": '"X"'} and hub.query({"entityId": "nobody"}).rows.first().props is None
    assert hub.query({"entityId": "ns1:1", "details": True}).rows.first().n_changes == 1
    whole = json.loads(hub.query({"entityId": "ns1:1", "noPartialMerging": True}).rows.first().props)
    assert whole["core:partials"][0]["props"] == {"core:datasetname": "companies", "ns1:name": "X"}
    for bad in ({}, {"startingEntities": ["x"]}, {"startingEntities": ["ns0:1"], "predicate": "zz:works"}):
        with pytest.raises(ValueError):
            hub.query(bad)


def test_paged_query_stops_when_told(spark):
    log = spark.createDataFrame([("d", 0, "a", 1, 0, False, "{}", json.dumps({"r": [f"t{i}" for i in range(10)]}))], SCHEMA)
    catalog = spark.createDataFrame([("d", 1, False)], "dataset string, dataset_id int, deleted boolean")
    pages = []

    def call(df):
        pages.append(df.count())
        return len(pages) < 2

    token = paged_query(log, catalog, None, Query(starts=["a"]), 3, call)
    assert pages == [3, 3] and token
    assert run_query(log, catalog, None, Query(continuation=token, limit=9)).rows.count() == 4
    pages.clear()
    assert paged_query(log, catalog, None, Query(starts=["a"]), 4, lambda df: not pages.append(df.count())) is None and pages == [4, 4, 2]


def test_jobs_run_on_change(hub):
    config = {"id": "copy", "title": "Copy", "source": {"Type": "DatasetSource", "Name": "people"}, "sink": {"Type": "DatasetSink", "Name": "companies"}, "triggers": [{"triggerType": "onchange", "jobType": "incremental", "monitoredDataset": "people"}, {"triggerType": "cron", "jobType": "fullsync", "schedule": "@daily"}]}
    hub.add_job(config)
    hub.post_entities("people", doc({"id": "p:1"}))
    assert hub.entities("companies").count() == 1 and hub.jobs.history("copy")[0]["processed"] == 1
    assert hub.jobs.schedules() == [("copy", "fullsync", "@daily")] and set_of(hub.lineage()) == {("people", "companies", "copy")}
    hub.jobs.reset_meta("copy")
    assert hub.jobs.history("copy") == []


def test_datasets_and_statistics(hub, spark, tmp_path):
    hub.post_entities("people", doc({"id": "p:1", "refs": {"p:r": ["p:2", "p:3"]}}))
    assert hub.dataset_info("people")["items"] == 1
    stats = {(r.source, r.dataset, r.deleted): r.n for r in hub.statistics("people").collect()}
    assert stats[("log", "people", None)] == stats[("latest", "people", False)] == 1 and stats[("links", "people", None)] == 2
    hub.compact()
    hub.rename_dataset("people", "persons")
    assert hub.datasets() == ["companies", "persons"]
    assert Hub(spark, str(tmp_path), [Rule("/datasets/p*")]).datasets() == ["persons"]
    hub.delete_dataset("persons")
    hub.collect_garbage()
    hub.delete_all()
    assert hub.datasets() == [] and hub.relations().count() == 0


def test_parts_of_an_entity(spark):
    rows = [("b", 0, 'e"1', 5, 0, False, '{"n":1}', '{"r":"x"}'), ("a", 0, 'e"1', 6, 0, False, "{ }", "{}"), ("a", 1, "gone", 7, 0, True, "{}", "{}")]
    catalog = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, dataset_id int")
    parts = graph.partials(snapshot.latest(spark.createDataFrame(rows, SCHEMA)), catalog)
    got = {r.entity_id: (r.deleted, json.loads(r.props)["k"]) for r in graph.with_partials(parts, "k", "ds").collect()}
    assert got['e"1'] == (False, [{"id": 'e"1', "deleted": False, "props": {"ds": "a"}, "refs": {}}, {"id": 'e"1', "deleted": False, "props": {"ds": "b", "n": 1}, "refs": {"r": "x"}}])
    assert got["gone"][0] is True


def test_events():
    bus, got = EventBus(), []
    bus.subscribe("a", r"dataset\.p.*", got.append)
    bus.subscribe("b", r"dataset\.people", lambda t: 1 / 0)
    assert bus.emit("dataset.people") == ["a", "b"] and bus.emit("dataset.x") == [] and got == ["dataset.people"]
    bus.unsubscribe("b")
    assert bus.emit("dataset.people") == ["a"]


def test_diagnostics(caplog):
    with caplog.at_level("INFO", "strandlog.user"):
        log({"a": 1})
        log("hidden", "debug")
    assert [r.getMessage() for r in caplog.records] == ["{'a': 1}"]
    t = Timings(iter(range(10)).__next__)
    t.timing("x")
    t.timing("x", end=True)
    t.timing("never", end=True)
    assert t.seconds == {"x": [1]}


def test_lineage_rows():
    assert maintenance.lineage_row({"source": {"DatasetSources": [{"Name": "a"}, {"Name": "b"}]}, "sink": {"Url": "http://x"}, "transform": {"Type": "t"}}) == (["a", "b"], ["http://x"], True, [], [])
    assert maintenance.lineage_row({"source": {}, "sink": {"Type": "DevNullSink"}}) == ([], [], False, [], [])


def test_error_handlers_of_a_job_are_used(hub):
    def no_bad(df):
        return df.withColumn("props", F.when(F.col("entity_id").endswith("2"), F.raise_error(F.lit("bad row"))).otherwise(F.col("props")))

    def job(name, handlers, kind="incremental"):
        return {"id": name, "title": name, "source": {"Type": "DatasetSource", "Name": "people"}, "sink": {"Type": "DatasetSink", "Name": "companies"}, "triggers": [{"triggerType": "cron", "jobType": kind, "schedule": "@daily", "onError": handlers}]}

    hub.post_entities("people", doc(*[{"id": f"p:{i}"} for i in range(4)]))
    hub.add_job(job("log", [{"errorHandler": "log"}]), [no_bad])
    record = hub.jobs.run("log")
    assert record["ok"] and record["skipped"] == 1 and hub.entities("companies").count() == 3

    tries = []

    def second_time(df):
        tries.append(1)
        if len(tries) < 2:
            raise RuntimeError("down")
        return df

    hub.add_job(job("again", [{"errorHandler": "reRun", "maxRetries": 1, "retryDelay": 0.01}]), [second_time])
    assert hub.jobs.run("again")["ok"] and len(tries) == 2
    for wrong in (job("q", [{"errorHandler": "reQueue"}]), job("f", [{"errorHandler": "log"}], "fullsync")):
        with pytest.raises(ValueError, match="not supported"):
            hub.add_job(wrong)


def job(name, source, sink, **more):
    return {"id": name, "title": name, "source": source, "sink": sink, "triggers": [{"triggerType": "onchange", "jobType": "incremental", "monitoredDataset": "people"}], **more}


PEOPLE, COMPANIES = {"Type": "DatasetSource", "Name": "people"}, {"Type": "DatasetSink", "Name": "companies"}


def test_a_whole_job_configuration_is_applied(hub, spark, tmp_path):
    """Function transform, virtual source, chained jobs, restart; nothing configured is ignored."""
    def shout(df):
        return df.withColumn("props", F.lit('{"loud":1}'))

    def made(params, since, limit):
        return spark.createDataFrame([(f"v{params['n']}", False, "{}", "{}")], "entity_id string, deleted boolean, props string, refs string"), "t"

    functions = {"shout": shout, "made": made}
    hub.create_dataset("copies")
    hub.create_dataset("dreamt", kind="virtual", build="Made", params={"n": 7})
    one = Hub(spark, str(tmp_path), functions=functions)
    one.add_job(job("loud", PEOPLE, COMPANIES, transform={"Type": "FunctionTransform", "Name": "SHOUT", "Parallelism": 2}))
    one.add_job(job("chain", {"Type": "DatasetSource", "Name": "companies"}, {"Type": "DatasetSink", "Name": "copies"}, triggers=[{"triggerType": "onchange", "jobType": "incremental", "monitoredDataset": "companies"}]))
    one.add_job(job("dream", {"Type": "DatasetSource", "Name": "dreamt"}, COMPANIES))
    one.jobs.pause("dream")
    one.post_entities("people", doc({"id": "p:1"}))
    assert [r.props for r in one.entities("companies").collect()] == ['{"loud":1}'] and one.entities("copies").count() == 1  # the write of one job set off the other
    assert one.changes("dreamt")[1] == "t" and [r.entity_id for r in one.changes("dreamt")[0].collect()] == ["v7"]
    again = Hub(spark, str(tmp_path), functions=functions)
    assert again.jobs.jobs() == ["chain", "dream", "loud"] and again.jobs.run("dream") is None and again.broken == {}
    again.jobs.resume("dream")
    assert again.jobs.run("dream")["processed"] >= 1 and again.jobs.run("loud")["processed"] == 0  # tokens are kept
    assert set(Hub(spark, str(tmp_path)).broken) == {"loud", "dream"}
    again.jobs.delete("loud")
    assert Hub(spark, str(tmp_path), functions=functions).jobs.jobs() == ["chain", "dream"]


@pytest.mark.parametrize(
    "change",
    [{"transform": {"Type": "JavascriptTransform", "Code": "x"}}, {"transform": {"Type": "FunctionTransform", "Name": "nobody"}}, {"transform": {"Type": "HttpTransform", "Url": "http://x.invalid", "TokenProvider": "nobody"}}, {"transform": {"Type": "HttpTransform", "Url": "http://x.invalid", "What": 1}},
     {"source": {**PEOPLE, "What": 1}}, {"sink": {"Type": "HttpDatasetSink", "Url": "http://x.invalid", "TokenProvider": "nobody"}}, {"source": {"Type": "HttpDatasetSource", "Url": "http://x.invalid", "TokenProvider": "nobody"}}, {"what": 1}],
)
def test_what_has_no_effect_is_an_error(hub, change):
    with pytest.raises(ValueError):
        hub.add_job({**job("j", PEOPLE, COMPANIES), **change})


def test_queries_tracked_by_a_transform(hub, spark, tmp_path):
    def join(df):
        return df.select("entity_id", "deleted", "props", "refs")

    join.track_queries = lambda tracker: tracker.hop("companies", "ns0:works")
    h = Hub(spark, str(tmp_path), functions={"join": join})
    h.create_dataset("out")
    h.add_job(job("multi", {"Type": "MultiSource", "Name": "people"}, {"Type": "DatasetSink", "Name": "out"}, transform={"Type": "FunctionTransform", "Name": "join"}))
    assert [d.dataset for d in h.jobs._jobs["multi"][0].source.dependencies] == ["companies"]


def test_user_queries_and_contents(hub, spark, tmp_path):
    functions = {"names": lambda h, least: h.entities("people").where(F.col("entity_id") >= least).select("entity_id"), "plain": lambda h: iter([1, {"a": "b"}]), "none": lambda h: []}
    h = Hub(spark, str(tmp_path), functions=functions)
    h.post_entities("people", doc({"id": "p:1"}, {"id": "p:2"}))
    assert sorted(e["entity_id"] for e in json.loads("".join(h.user_query("names", least="ns0:2")))) == ["ns0:2"]
    assert json.loads("".join(h.user_query("plain"))) == [1, {"a": "b"}] and "".join(h.user_query("none")) == "[]"
    h.store.put_content("b", {"x": 1})
    h.store.put_content("a", {"y": 2})
    assert h.store.contents() == {"a": {"y": 2}, "b": {"x": 1}}
