import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from strandlog.api import Hub
from strandlog.identity import Namespaces
from strandlog.model import SCHEMA
from strandlog.plans.pipeline import JobState, Pipeline
from strandlog.sources import formats
from strandlog.sources.datasource import _Stream, register_endpoint, register_virtual
from strandlog.sources.http import get_page, http_transform, post_entities, post_full_sync, with_query
from strandlog.sources.readers import HttpDatasetSource, make_source
from strandlog.sources.sinks import HttpDatasetSink

CONTEXT = {"id": "@context", "namespaces": {"a": "http://a.invalid/", "_": "http://d.invalid/"}}


def stream(*entities, token=None):
    return json.dumps([CONTEXT, *entities, *([{"id": "@continuation", "token": token}] if token else [])])


def test_parsing():
    rows, token = formats.parse_stream(stream({"id": "a:1", "recorded": 5, "unknown": "scalar", "props": {"a:x": 1.0, "y": None, "a:n": {"id": "a:2", "props": {"a:z": [1, {"props": {"w": 2}}]}}}, "refs": {"a:r": "a:2", "l": ["a:3", "http://full.invalid/4"]}, "deleted": True}, {"id": "plain"}, token="t1"))
    assert token == "t1" and [r[0] for r in rows] == ["http://a.invalid/1", "http://d.invalid/plain"]
    assert rows[0][1:3] == (5, True)
    assert json.loads(rows[0][3]) == {"http://a.invalid/x": 1, "http://a.invalid/n": {"id": "http://a.invalid/2", "props": {"http://a.invalid/z": [1, {"props": {"http://d.invalid/w": 2}}]}}}
    assert json.loads(rows[0][4]) == {"http://a.invalid/r": "http://a.invalid/2", "http://d.invalid/l": ["http://a.invalid/3", "http://full.invalid/4"]}


@pytest.mark.parametrize(
    "text",
    ["", "{}", "[]", '[{"id":"x"}]', stream({"id": "a:1"})[:-1], stream({"id": "zz:1"}), stream({"props": {}}), stream({"id": "a:1", "other": {}}), stream({"id": "a:1", "refs": {"a:r": None}}), stream({"id": "a:1", "refs": {"a:r": ["a:2", None]}}), stream({"id": "a:1", "props": {"a:x": [None]}}), stream({"id": ""}), stream({"id": 5}), stream("x"), json.dumps([{"id": "@context"}, {"id": "nodefault"}])],
)
def test_broken_documents(text):
    with pytest.raises(formats.FormatError):
        formats.parse_stream(text)


def test_transactions():
    doc = json.dumps({"@context": {"namespaces": CONTEXT["namespaces"]}, "people": [{"id": "a:1"}], "companies": [{"id": "a:2"}, {"id": "a:3"}]})
    assert {d: len(r) for d, r in formats.parse_transaction(doc).items()} == {"people": 1, "companies": 2}
    for bad in ("[]", '{"people": []}', '{"people": [], "@context": {}}', "{"):
        with pytest.raises(formats.FormatError):
            formats.parse_transaction(bad)


def test_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.json").write_text(stream({"id": f"a:{i}"}, {"id": "é"}))
    names = Namespaces(spark.createDataFrame([("ns0", "http://a.invalid/", 0)], "prefix string, expansion string, ord int"))
    got = {(r.pos, r.entity_id) for r in names.compress(formats.read_streams(spark, str(tmp_path)), "entity_id").collect()}
    assert got == {(0, "ns0:0"), (0, "ns0:1"), (0, "ns0:2"), (1, "http://d.invalid/é")}


ROW = ("d", 0, 'a:"1"', 5, 0, False, '{"a:x":[1,{"y":"é\\n"}],"a:s":"t"}', '{"a:r":"a:2","a:l":["a:3","a:4"]}')


def test_writing_round_trips(spark):
    df = spark.createDataFrame([ROW, ("d", 1, "a:2", 6, 0, True, "{}", "{}")], SCHEMA)
    texts = [r.json for r in formats.entity_json(df).collect()]
    e = json.loads(texts[0])
    assert e == {"id": 'a:"1"', "recorded": 5, "deleted": False, "props": json.loads(ROW[6]), "refs": json.loads(ROW[7])} and json.loads(texts[1])["deleted"] is True
    whole = "".join(formats.stream_text(CONTEXT, iter(texts), "next"))
    rows, token = formats.parse_stream(whole.replace('"y"', '"id":"a:9","ignored"'))
    assert token == "next" and len(rows) == 2


def test_jsonld(spark):
    df = spark.createDataFrame([ROW, ("d", 1, "a:2", 6, 0, False, "{}", "{}")], SCHEMA)
    nodes = [json.loads(r.json) for r in formats.jsonld(df).collect()]
    assert nodes == [{"@id": 'a:"1"', "a:x": [1, {"y": "é\n"}], "a:s": "t", "a:r": {"@id": "a:2"}, "a:l": [{"@id": "a:3"}, {"@id": "a:4"}]}, {"@id": "a:2"}]
    assert {"a", "core", "rdf"} <= set(formats.jsonld_context(CONTEXT)["@context"]) and formats.jsonld_continuation("t")["rdf:type"] == {"@id": "core:continuation"}


class Remote(BaseHTTPRequestHandler):
    """Serves pages of two entities and keeps what is posted."""

    entities, posts, fail = [f"a:{i}" for i in range(5)], [], 0

    def log_message(self, *_):
        pass

    def answer(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        a = int(q.get("since", ["0"])[0])
        n = int(q.get("limit", ["2"])[0])
        page = self.entities[a : a + n]
        self.answer(stream(*[{"id": e, "props": {"a:x": self.headers.get("Authorization", "")}} for e in page], token=str(a + len(page))))

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if Remote.fail:
            Remote.fail -= 1
            self.answer("", 500)
        elif self.path == "/transform":
            Remote.posts.append((dict(self.headers), body))
            back = [{**e, "id": e["id"] + "!"} if e["id"] != "@context" else {"id": "@context", "namespaces": {**e["namespaces"], "n": "http://new.invalid/"}} for e in body]
            self.answer(json.dumps(back + [{"id": "n:9", "refs": {"a:r": ["a:1", "n:2"]}}] * (body[0]["id"] == "@context")))
        else:
            Remote.posts.append((dict(self.headers), body))
            self.answer("")


@pytest.fixture
def remote():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Remote)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Remote.posts, Remote.fail = [], 0
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote_source(spark, remote):
    assert with_query("http://x", since=None, limit=3) == "http://x?limit=3" and with_query("http://x?a=1", since="s") == "http://x?a=1&since=s"
    rows, token = get_page(remote, limit=3, token=lambda: "secret")
    assert len(rows) == 3 and token == "3" and "Bearer secret" in rows[0][3]
    source = HttpDatasetSource(spark, remote)
    rows, token = source.read("3")
    assert [r.entity_id for r in rows.collect()] == ["http://a.invalid/3", "http://a.invalid/4"] and token == "5"
    assert source.read_all()[0].count() == 5


def test_remote_as_data_source(spark, remote, tmp_path):
    register_endpoint(spark)
    assert spark.read.format("entities").option("url", remote).load().count() == 5
    rows = spark.readStream.format("entities").option("url", remote).load()
    q = rows.writeStream.format("memory").queryName("remote_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    for _ in range(60):
        if spark.table("remote_rows").count() >= 5:
            break
        q.awaitTermination(0.5)
    q.stop()
    assert spark.table("remote_rows").select("entity_id").distinct().count() == 5


def test_remote_sink(spark, remote, tmp_path):
    df = spark.createDataFrame([("d", i, f"a:{i}", 5, 0, False, "{}", "{}") for i in range(25)], SCHEMA).coalesce(1)
    Remote.fail = 1
    post_entities(df, remote + "/x", CONTEXT, batch=10, pause=0)
    assert [len(b) for _, b in Remote.posts] == [11, 11, 6] and all(b[0]["id"] == "@context" for _, b in Remote.posts)
    Remote.posts.clear()
    post_full_sync(df, remote + "/x", CONTEXT, "s1", batch=100)
    heads = [{k.lower(): v for k, v in h.items() if "sync" in k.lower()} for h, _ in Remote.posts]
    assert heads == [{"full-sync-id": "s1", "full-sync-start": "true"}, {"full-sync-id": "s1"}, {"full-sync-id": "s1", "full-sync-end": "true"}]
    state = JobState(str(tmp_path))
    Pipeline("j", HttpDatasetSource(spark, remote), HttpDatasetSink(remote + "/x", CONTEXT), state).run(full=True)
    assert state.load("j")["token"] == ""  # the remote may have lost the sync


def test_remote_transform(spark, remote):
    df = spark.createDataFrame([("d", 0, "a:x", 5, 0, False, '{"a:p":1}', "{}"), ("d", 1, "a:y", 6, 0, True, "{}", '{"a:r":"a:x"}')], SCHEMA).coalesce(1)
    got = http_transform(remote + "/transform", token=lambda: "secret")(df).collect()
    assert [tuple(r) for r in got] == [("a:x!", 5, False, '{"a:p":1}', "{}"), ("a:y!", 6, True, "{}", '{"a:r":"a:x"}')]
    heads, body = Remote.posts[0]
    assert heads["Authorization"] == "Bearer secret" and body[0] == {"id": "a:x", "recorded": 5, "deleted": False, "refs": {}, "props": {"a:p": 1}}
    got = http_transform(remote + "/transform", 0, context=CONTEXT)(df).collect()
    assert [r.entity_id for r in got] == ["a:x!", "a:y!", "http://new.invalid/9"] and json.loads(got[2].refs) == {"a:r": ["a:1", "http://new.invalid/2"]} and Remote.posts[1][1][0] == CONTEXT


def test_proxies_and_token_providers_of_jobs(spark, remote, tmp_path):
    hub = Hub(spark, str(tmp_path), tokens={"Keeper": lambda: "secret"})
    hub.create_dataset("local")
    hub.create_dataset("away", kind="proxy", url=remote, token_provider="keeper")
    trigger = [{"triggerType": "cron", "jobType": "incremental", "schedule": "@daily"}]
    hub.add_job({"id": "in", "title": "in", "source": {"Type": "DatasetSource", "Name": "away"}, "sink": {"Type": "DatasetSink", "Name": "local"}, "triggers": trigger})
    assert hub.jobs.run("in")["processed"] == 5 and hub.entities("local").count() == 5
    assert "Bearer secret" in hub.entities("local").first().props and hub.jobs.run("in")["processed"] == 0
    assert hub.changes("away", "3")[0].count() == 2
    hub.add_job({"id": "out", "title": "out", "source": {"Type": "DatasetSource", "Name": "local"}, "sink": {"Type": "DatasetSink", "Name": "away"}, "transform": {"Type": "HttpTransform", "Url": remote + "/transform", "TokenProvider": "KEEPER"}, "triggers": trigger})
    assert hub.jobs.run("out")["ok"] and {h["Authorization"] for h, _ in Remote.posts} == {"Bearer secret"}
    assert all(e["id"].endswith("!") for _, b in Remote.posts if b[0]["id"] == "@context" for e in b[1:])


def test_a_repeated_stream_batch_is_the_same(remote):
    stream = _Stream({"url": remote})
    rows, end = stream.read(stream.initialOffset())
    first = list(rows)
    Remote.entities = [*Remote.entities, "a:late"]
    try:
        assert end == {"token": "2", "rows": 2} and list(stream.readBetweenOffsets(stream.initialOffset(), end)) == first
        rows, end2 = stream.read(end)
        assert list(stream.readBetweenOffsets(stream.initialOffset(), end2)) == first + list(rows)
        with pytest.raises(RuntimeError, match="repeated"):
            list(stream.readBetweenOffsets(stream.initialOffset(), {"token": "x", "rows": 99}))
    finally:
        Remote.entities = Remote.entities[:-1]


def test_a_slow_source_gives_its_entities_every_time(spark):
    source = make_source({"Type": "SlowSource", "BatchSize": 3, "Sleep": "10ms"}, spark, None)
    assert [source.read(t)[0].count() for t in ("", source.read("")[1])] == [3, 3]


def test_virtual_dataset_in_sql(spark):
    register_virtual(spark, "made_up", lambda since, limit: ((f"{since}{i}", i, False, "{}", "{}") for i in range(limit)))
    assert [r.entity_id for r in spark.sql("SELECT entity_id FROM made_up('v', 3)").collect()] == ["v0", "v1", "v2"]
