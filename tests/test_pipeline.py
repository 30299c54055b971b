import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from strandlog.operators import snapshot
from strandlog.operators.incremental import Dependency, Join
from strandlog.plans.pipeline import ErrorPolicy, JobManager, JobState, Pipeline, Raffle, per_batch
from strandlog.plans.schedule import Schedule
from strandlog.sources.durations import seconds
from strandlog.sources.readers import DatasetSource, MultiSource, SampleSource
from strandlog.sources.sinks import ConsoleSink, DatasetSink, DevNullSink, HttpDatasetSink, make_sink
from strandlog.store import EntityStore

ROWS = "entity_id string, deleted boolean, props string, refs string, pos bigint"


@pytest.fixture
def store(spark, tmp_path):
    s = EntityStore(spark, str(tmp_path / "store"))
    for name in ("people", "companies", "employees"):
        s.create_dataset(name)
    return s


@pytest.fixture
def state(tmp_path):
    return JobState(str(tmp_path / "jobs"))


def put(spark, store, dataset, *rows):
    return store.store_entities(dataset, spark.createDataFrame([(i, d, json.dumps(p), json.dumps(r), n) for n, (i, d, p, r) in enumerate(rows)], ROWS))


def fill(spark, store, n):
    put(spark, store, "people", *[(f"e{i:02}", False, {"n": i}, {}) for i in range(n)])


def test_incremental_run_goes_on_from_its_token(spark, store, state):
    fill(spark, store, 7)
    job = Pipeline("j", DatasetSource(store.changes, "people"), DatasetSink(store, "employees"), state, batch=3)
    assert job.run()["processed"] == 7 and state.load("j")["token"] == "7" and store.entities("employees").count() == 7
    assert job.run()["processed"] == 0
    put(spark, store, "people", ("e00", True, {}, {}))
    assert job.run()["processed"] == 1 and store.entities("employees").where("deleted").count() == 1


def test_full_run_deletes_what_is_gone(spark, store, state):
    fill(spark, store, 3)
    put(spark, store, "employees", ("old", False, {}, {}))
    job = Pipeline("j", DatasetSource(store.changes, "people"), DatasetSink(store, "employees"), state)
    assert job.run(full=True)["processed"] == 3 and state.load("j")["token"] == "3"
    assert [r.entity_id for r in store.entities("employees").where("deleted").collect()] == ["old"]


class Failing:
    """A sink that fails on some entities, or a number of times."""

    def __init__(self, bad=(), times=0):
        self.bad, self.times, self.got = set(bad), times, []

    def write(self, df):
        if self.times:
            self.times -= 1
            raise RuntimeError("down")
        names = [r.entity_id for r in df.collect()]
        if self.bad & set(names):
            raise RuntimeError("bad rows")
        self.got += names
        return len(names)

    write_all = write


def test_a_failure_repeats_only_its_step(spark, store, state):
    fill(spark, store, 6)
    sink = Failing(bad=["e04"])
    job = Pipeline("j", DatasetSource(store.changes, "people"), sink, state, batch=3)
    record = job.run()
    assert not record["ok"] and record["error"] == "bad rows" and state.load("j")["token"] == "3"
    sink.bad = set()
    assert job.run()["ok"] and sorted(sink.got) == [f"e{i:02}" for i in range(6)]


def test_failing_rows_are_found_and_set_aside(spark, store, state):
    fill(spark, store, 10)
    sink = Failing(bad=["e03", "e07"])
    job = Pipeline("j", DatasetSource(store.changes, "people"), sink, state, errors=ErrorPolicy(skip=True, max_items=5))
    record = job.run()
    assert record["ok"] and record["error"] == "bad rows" and record["skipped"] == 2
    assert sorted(r["entity_id"] for r in job.failed) == ["e03", "e07"] and len(sink.got) == 8
    few = Pipeline("k", DatasetSource(store.changes, "people"), Failing(bad=["e03", "e07"]), state, errors=ErrorPolicy(skip=True, max_items=1))
    assert not few.run()["ok"]


def test_rerun(spark, store, state):
    fill(spark, store, 2)
    job = Pipeline("j", DatasetSource(store.changes, "people"), Failing(times=2), state, errors=ErrorPolicy(retries=2, delay=0))
    assert job.run()["ok"]
    job = Pipeline("k", DatasetSource(store.changes, "people"), Failing(times=2), state, errors=ErrorPolicy(retries=1, delay=0))
    assert not job.run()["ok"]


def composed(spark, store, state, source):
    """Employees: persons with the name of their company, looked up as it is at the time of the run."""

    def join(df):
        names = snapshot.latest(store.changes().where("dataset = 'companies'"), include_deleted=False).select(F.col("entity_id").alias("c"), F.get_json_object("props", "$.name").alias("company"))
        who = df.withColumn("c", F.get_json_object("refs", "$.worksfor")).join(names, "c", "left")
        props = F.to_json(F.struct(F.get_json_object("props", "$.name").alias("name"), F.col("company").alias("companyname")))
        refs = F.to_json(F.struct(F.get_json_object("refs", "$.friend").alias("friend")))
        return who.select("entity_id", "deleted", props.alias("props"), refs.alias("refs"), F.col("seq").alias("pos"))

    return Pipeline("composed", source, DatasetSink(store, "employees"), state, [join])


def test_composed_dataset_follows_both_sources(spark, store, state):
    source = MultiSource(store.changes, "people", [Dependency("companies", (Join("people", "worksfor", inverse=True),))], latest_only=True)
    job = composed(spark, store, state, source)
    put(spark, store, "companies", ("acme", False, {"name": "M1"}, {}))
    put(spark, store, "people", ("homer", False, {"name": "H1"}, {"worksfor": "acme"}))
    job.run()
    put(spark, store, "companies", ("acme", False, {"name": "M2"}, {}))
    job.run()
    put(spark, store, "people", ("homer", False, {"name": "H2"}, {"worksfor": "acme"}))
    job.run()
    job.run()
    got = [(json.loads(r.props)["name"], json.loads(r.props)["companyname"]) for r in store.feed("employees").collect()]
    assert got == [("H1", "M1"), ("H1", "M2"), ("H2", "M2")]


@pytest.mark.parametrize(("latest_only", "every_step", "changes"), [(False, True, 24), (True, True, 8), (False, False, 5)])
def test_full_runs_over_a_changing_history(spark, store, state, latest_only, every_step, changes):
    """A person and a company change in turn: a full run replays all of the person's versions, unless only the newest count."""
    job = composed(spark, store, state, DatasetSource(store.changes, "people", latest_only))

    def homer(name, **refs):
        put(spark, store, "people", ("homer", False, {"name": name}, {"worksfor": "acme", **refs}))

    def acme(name):
        put(spark, store, "companies", ("acme", False, {"name": name}, {}))

    homer("homer_1")
    acme("A1")
    steps = [lambda: None, lambda: homer("homer_2", friend="barney"), lambda: acme("A2"), lambda: homer("homer_3"), lambda: homer("homer_1"), lambda: acme("A3"), lambda: homer("homer_4"), lambda: acme("A4")]
    for step in steps:
        step()
        if every_step:
            assert job.run(full=True)["ok"]
    if not every_step:
        assert job.run(full=True)["ok"]
    got = [(p["name"], p["companyname"]) for r in store.feed("employees").collect() for p in [json.loads(r.props)]]
    assert len(got) == changes and got[-1] == ("homer_4", "A4")
    if every_step and not latest_only:
        assert got[:4] == [("homer_1", "A1"), ("homer_2", "A1"), ("homer_1", "A2"), ("homer_2", "A2")]


def test_user_transform(spark, state):
    up = per_batch(lambda pdf: pdf.assign(entity_id=pdf.entity_id.str.upper()), "entity_id string, deleted boolean, props string, refs string", workers=3)
    sink = Failing()
    Pipeline("j", SampleSource(spark, 4), sink, state, [up]).run()
    assert sorted(sink.got) == ["E-0", "E-1", "E-2", "E-3"]


def test_raffle():
    r = Raffle(full=1, incremental=2)
    assert r.take("a", True) and not r.take("a", False) and not r.take("b", True)
    assert r.take("b", False) and r.take("c", False) and not r.take("d", False) and r.running() == ["a", "b", "c"]
    r.give_back("a")
    r.give_back("unknown")
    assert r.take("d", True)


CONFIG = {"id": "j", "title": "J", "source": {"Type": "SampleSource"}, "sink": {"Type": "DevNullSink"}, "triggers": [{"triggerType": "onchange", "jobType": "incremental", "monitoredDataset": "people"}, {"triggerType": "cron", "jobType": "fullsync", "schedule": "@daily"}]}


def test_job_manager(spark, store, state):
    m = JobManager(state)
    sink = Failing()
    m.add(CONFIG, Pipeline("j", SampleSource(spark, 3), sink, state))
    assert m.jobs() == ["j"] and m.on_change("other") == [] and m.on_change("people") == ["j"] and len(sink.got) == 3
    m.pause("j")
    assert m.run("j") is None
    m.resume("j")
    assert m.run("j")["processed"] == 0
    m.reset_token("j")
    assert m.run("j")["processed"] == 3 and [h["processed"] for h in m.history("j")] == [3, 0, 3] and m.status() == []
    m.kill("j")
    assert m.run("j")["processed"] == 0
    m.delete("j")
    assert m.jobs() == []


@pytest.mark.parametrize(
    "change",
    [{"id": ""}, {"title": ""}, {"nonsense": 1}, {"source": None}, {"sink": {}}, {"triggers": []}, {"triggers": [{"triggerType": "cron", "jobType": "fullsync"}]}, {"triggers": [{"triggerType": "onchange", "jobType": "incremental"}]}, {"triggers": [{"triggerType": "x", "jobType": "fullsync"}]}, {"triggers": [{"triggerType": "cron", "jobType": "x", "schedule": "@daily"}]},
     {"triggers": [CONFIG["triggers"][0], {**CONFIG["triggers"][1], "onError": [{"errorHandler": "log"}, {"errorHandler": "log"}]}]}, {"triggers": [CONFIG["triggers"][0], {**CONFIG["triggers"][1], "onError": [{"errorHandler": "what"}]}]}],
)
def test_wrong_configurations(change):
    JobManager.verify(CONFIG)
    with pytest.raises(ValueError):
        JobManager.verify({**CONFIG, **change})


def test_sinks(spark, store):
    rows = spark.range(3).selectExpr("cast(id as string) entity_id")
    said = []
    assert DevNullSink().write(rows) == 0 and ConsoleSink("> ", out=said.append).write(rows) == 3 and ConsoleSink(detailed=True, out=said.append).write(rows) == 3
    assert said[0] == "> 3 entities" and len(said) == 4
    store.create_dataset("remote", "proxy", url="http://r.invalid")
    assert isinstance(make_sink({"Type": "DatasetSink", "Name": "people"}, store), DatasetSink) and isinstance(make_sink({"Type": "DatasetSink", "Name": "remote"}, store), HttpDatasetSink)
    assert isinstance(make_sink({"Type": "HttpDatasetSink", "Url": "http://r.invalid"}), HttpDatasetSink) and isinstance(make_sink({"Type": "DevNullSink"}), DevNullSink) and isinstance(make_sink({"Type": "ConsoleSink"}), ConsoleSink)
    with pytest.raises(ValueError, match="unknown"):
        make_sink({"Type": "x"})


def test_a_kill_ends_one_run_only(spark, state):
    m = JobManager(state)
    held = []

    class Killing(Failing):
        def write(self, df):
            n = super().write(df)
            if not held:
                held.append(m.kill("j"))
            return n

    sink = Killing()
    m.add(CONFIG, Pipeline("j", SampleSource(spark, 5), sink, state, batch=2))
    record = m.run("j")
    assert not record["ok"] and record["error"] == "killed" and record["processed"] == 2 == len(sink.got)
    record = m.run("j")
    assert record["ok"] and record["processed"] == 3 and len(sink.got) == 5


def test_error_limits_count_per_run(spark, store, state):
    fill(spark, store, 6)
    sink = Failing(bad=["e01", "e04"])
    job = Pipeline("j", DatasetSource(store.changes, "people"), sink, state, errors=ErrorPolicy(skip=True, max_items=3))
    assert [job.run()["skipped"], job.state.update("j", token=""), job.run()["skipped"]] == [2, None, 2]
    sink.bad = set()
    assert job.run() | {"started": 0, "ended": 0} == {"full": False, "ok": True, "error": None, "started": 0, "ended": 0, "processed": 0, "skipped": 0}
    job = Pipeline("k", DatasetSource(store.changes, "people"), Failing(bad=["e01", "e04"]), state, errors=ErrorPolicy(skip=True))  # 0: any number
    assert job.run()["skipped"] == 2
    job = Pipeline("l", DatasetSource(store.changes, "people"), Failing(bad=["e01", "e04"]), state, errors=ErrorPolicy(skip=True, max_items=2))
    record = job.run()
    assert not record["ok"] and "2 rows failed" in record["error"] and state.load("l")["token"] == ""


def test_a_kill_ends_a_full_run_and_its_spark_jobs(spark, state):
    m = JobManager(state)

    class Slow:
        def write(self, df):
            threading.Timer(1.0, m.kill, ["j"]).start()
            return spark.range(200, numPartitions=200).mapInPandas(lambda it: (__import__("time").sleep(0.5) or x for x in it), "id bigint").count()

        write_all = write

    m.add(CONFIG, Pipeline("j", SampleSource(spark, 5), Slow(), state))
    began = time.time()
    record = m.run("j", full=True)
    assert not record["ok"] and record["error"] == "killed" and time.time() - began < 15


def test_titles_are_unique(spark, state):
    m = JobManager(state)
    m.add(CONFIG, Pipeline("j", SampleSource(spark, 1), DevNullSink(), state))
    m.add(CONFIG, Pipeline("j", SampleSource(spark, 1), DevNullSink(), state))  # replaces itself
    with pytest.raises(ValueError, match="title"):
        m.add({**CONFIG, "id": "k"}, Pipeline("k", SampleSource(spark, 1), DevNullSink(), state))


def test_cron_triggers_fire(spark, state):
    m = JobManager(state)
    m.add({**CONFIG, "triggers": [{"triggerType": "cron", "jobType": "fullSync", "schedule": "*/5 * * * *"}]}, Pipeline("j", SampleSource(spark, 1), DevNullSink(), state))
    noon = 1_735_732_800.0
    assert m.tick(noon) == [] and m.tick(noon + 299) == [] and m.tick(noon + 300) == ["j"] and m.tick(noon + 310) == [] and m.tick(noon + 3600) == ["j"] and m.tick(noon + 3601) == []
    assert [h["full"] for h in m.history("j")] == [True, True]


def test_a_clock_runs_what_is_due(spark, state):
    m = JobManager(state)
    m.add({**CONFIG, "triggers": [{"triggerType": "cron", "jobType": "incremental", "schedule": "@every 1s"}]}, Pipeline("j", SampleSource(spark, 1), DevNullSink(), state))
    m.start(0.2)
    until = time.time() + 20
    while not m.history("j") and time.time() < until:
        time.sleep(0.2)
    m.stop()
    assert m.history("j")[0]["ok"]


@pytest.mark.parametrize(
    ("text", "after", "due"),
    [("0 0 * * *", "2025-01-01 00:00", "2025-01-02 00:00"), ("@hourly", "2025-01-01 00:30", "2025-01-01 01:00"), ("30 8-10/2 * * mon,wed", "2025-01-01 09:00", "2025-01-01 10:30"), ("0 12 29 2 *", "2025-01-01 00:00", "2028-02-29 12:00"),
     ("0 0 13 * fri", "2025-01-01 00:00", "2025-01-03 00:00"), ("0 0 */2 * 5", "2025-01-01 00:00", "2025-01-03 00:00"), ("@every 90s", "2025-01-01 00:00", "2025-01-01 00:01:30"), ("0 0 30 2 *", "2025-01-01 00:00", None)],
)
def test_schedules(text, after, due):
    at = lambda t: dt.datetime.fromisoformat(t).replace(tzinfo=dt.UTC).timestamp()
    assert Schedule.parse(text).after(at(after)) == (due and at(due))


@pytest.mark.parametrize("text", ["", "* * * *", "60 * * * *", "* * 0 * *", "* * * * mon-", "*/0 * * * *", "@every", "@every x", "@sometimes", "5-1 * * * *"])
def test_wrong_schedules(text):
    with pytest.raises(ValueError):
        Schedule.parse(text)


def test_durations():
    assert [seconds(x) for x in ("1s", "1h30m", "1.5s", "200ms", "0", 3)] == [1, 5400, 1.5, 0.2, 0, 3]
    for bad in ("", "1", "s", "1 s", "1x"):
        with pytest.raises(ValueError):
            seconds(bad)
