import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from strandlog.operators.increments import IncrementalRun, job_offsets, open_rows, plan_batches, sink_once

from .conftest import rows_of, set_of

RUNS = "job_id string, run_no int, source_names string, token string, lastrunok boolean, ended_at timestamp_ntz"
LOG = "dataset string, seq bigint, recorded bigint"
T = dt.datetime(2024, 1, 1)


def b64(n: int) -> str:
    return base64.b64encode(str(n).encode()).decode()


def test_token_shapes(spark):
    union = json.dumps({"Tokens": [{"Token": "3"}, {"Token": b64(4)}], "DatasetNames": ["b", "a"]})
    multi = json.dumps({"MainToken": "7", "DependencyTokens": {"b": {"Token": "2"}}})
    runs = [
        ("dec", 1, '["a"]', "12", True, T),
        ("b64", 1, '["a"]', b64(1147), True, T),
        ("union", 1, '["a", "b", "c"]', union, True, T),
        ("multi", 1, '["a", "b", "c"]', multi, True, T),
        ("null", 1, '["a"]', None, True, T),
        ("blank", 1, '["a"]', "", True, T),
        ("junk", 1, '["a"]', "%%%", True, T),
        ("never", 1, '["a"]', "5", False, T),
        ("open", 2, '["a"]', "9", None, T),
        ("open", 1, '["a"]', "5", True, T),
        ("latest", 1, '["a"]', "5", True, T),
        ("latest", 3, '["a"]', "6", True, T),
        ("latest", 4, '["a"]', "8", False, T),
        ("latest", 3, '["a"]', "6", True, T),
        (None, 1, '["a"]', "6", True, T),
        ("nosource", 1, None, "6", True, T),
        ("badsource", 1, "x", "6", True, T),
        ("norun", None, '["a", "a", null]', "6", True, None),
    ]
    assert set_of(job_offsets(spark.createDataFrame(runs, RUNS))) == {
        ("dec", "a", 12), ("b64", "a", 1147), ("union", "a", 4), ("union", "b", 3), ("union", "c", 0), ("multi", "a", 7), ("multi", "b", 2), ("multi", "c", 0),
        ("null", "a", 0), ("blank", "a", 0), ("junk", "a", 0), ("never", "a", 0), ("open", "a", 5), ("latest", "a", 6), ("norun", "a", 6),
    }


def test_open_rows_each_once(spark):
    log = [("a", i, i) for i in range(100)] + [("a", 50, 50)] * 3 + [("b", i, 0) for i in range(0, 30, 3)] + [(None, 1, 1), ("a", None, 1)]
    runs = [("j", 1, '["a", "b"]', json.dumps({"Tokens": [{"Token": "40"}, {"Token": "10"}], "DatasetNames": ["a", "b"]}), True, T), ("k", 1, '["b", "none"]', "1000", True, T)]
    df = spark.createDataFrame(log, LOG).withColumns({"batch": F.lit("x"), "from_seq": F.lit(1), "job_id": F.lit("y")})
    for span in (1, 7, 4096):
        found = set_of(open_rows(spark.createDataFrame(runs, RUNS), df, span))
        assert found == {("j", "a", i) for i in range(40, 100)} | {("j", "b", i) for i in range(12, 30, 3)}


def test_plan_is_cut_into_batches(spark):
    offsets = spark.createDataFrame([("j", "a", 5), ("j", "b", 5)], "job_id string, dataset string, offset bigint")
    log = spark.createDataFrame([("a", i, 0) for i in range(3, 25)], LOG)
    assert set_of(plan_batches(offsets, log, 10)) == {("j", "a", 0, 5, 9), ("j", "a", 1, 10, 19), ("j", "a", 2, 20, 24)}


def test_empty(spark):
    no_runs, no_log = spark.createDataFrame([], RUNS), spark.createDataFrame([], LOG)
    runs, log = spark.createDataFrame([("j", 1, '["a"]', "0", True, T)], RUNS), spark.createDataFrame([("a", 1, 1)], LOG)
    assert rows_of(open_rows(no_runs, log)) == rows_of(open_rows(runs, no_log)) == rows_of(open_rows(no_runs, no_log)) == []


def test_failures_neither_skip_nor_repeat(spark, tmp_path):
    log = [("a", i, i) for i in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, LOG)
    run = IncrementalRun(str(tmp_path), "j", ["a"], span=8)
    sink = spark.createDataFrame([], "job_id string, dataset string, seq bigint")

    batch = run.begin(frame(log))
    sink = sink.unionByName(sink_once(sink, batch.where("seq < 9")))  # stopped half way
    grown = [*log, ("a", 20, 20), ("a", 21, 0)]
    again = IncrementalRun(str(tmp_path), "j", ["a"], span=8)  # another process
    replay = again.begin(frame(grown))
    assert {r.seq for r in replay.collect()} == set(range(20))  # the plan as it was written
    sink = sink.unionByName(sink_once(sink, replay))
    assert sorted(r.seq for r in sink.collect()) == list(range(20))
    again.commit()
    assert {r.seq for r in again.begin(frame(grown)).collect()} == {20, 21}  # however old their recorded
    again.commit()
    again.commit()
    assert again.begin(frame(grown)).collect() == [] and again.offsets() == {"a": 22}


def test_commit_stopped_before_the_plan_was_removed(spark, tmp_path):
    log = spark.createDataFrame([("a", i, i) for i in range(5)], LOG)
    run = IncrementalRun(str(tmp_path), "j", ["a"])
    run.begin(log)
    plan = run._files.get("plan")
    run.commit()
    run._files.put("plan", plan)
    assert run.begin(log).collect() == []


def test_a_replay_looks_only_at_the_ranges_of_its_plan(spark, tmp_path, monkeypatch):
    log = spark.createDataFrame([(d, i, i) for d in "ab" for i in range(10)], LOG)
    run = IncrementalRun(str(tmp_path), "j", ["a", "b"])
    run.begin(log.where("seq < 4"))
    run.commit()
    run.begin(log.where("dataset = 'a'"))
    sink = spark.createDataFrame([("j", d, i) for d in "ab" for i in range(7)], "job_id string, dataset string, seq bigint")
    want = {("j", "a", i) for i in (4, 5, 6)}
    assert set_of(run.delivered(sink)) == want
    monkeypatch.setattr("strandlog.operators.increments._INLINE_RANGES", 0)
    assert set_of(run.delivered(sink)) == want
    run.commit()
    assert rows_of(run.delivered(sink)) == []
