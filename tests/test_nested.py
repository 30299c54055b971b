import json

from pyspark.sql import functions as F

from strandlog.jsoncanon import canonical, parse
from strandlog.operators.nested import decide, document_nodes, entities, node_links, references, schema_graph, shared_inlining

from .conftest import rows_of, set_of

SCHEMA = "record_id bigint, body string"


def brute(record_id: int, body: dict) -> set[tuple]:
    out = set()

    def refs(r, path):
        for p, v in (r or {}).items():
            todo = [(f"{path}/@refs/{p}", v)]
            while todo:
                at, x = todo.pop()
                if isinstance(x, str):
                    out.add((record_id, "ref", at, path))
                elif isinstance(x, list):
                    todo += [(f"{at}/{i}", y) for i, y in enumerate(x)]

    def value(v, at, up):
        if isinstance(v, list):
            for i, x in enumerate(v):
                value(x, f"{at}/{i}", up)
        elif isinstance(v, dict):
            out.add((record_id, "object", at, up))
            entity(v, at) if "props" in v or "refs" in v else plain(v, at)

    def plain(o, path):
        for k, v in o.items():
            value(v, f"{path}/{k}", path)

    def entity(o, path):
        plain(o.get("props") or {}, path)
        refs(o.get("refs"), path)

    entity(body, "")
    return out


BODY = {
    "id": "e1",
    "props": {
        "name": "x",
        "empty": {},
        "box": {"props": {"inner": {"a": 1, "b": {"c": None}}}, "refs": {"r": ["t1", ["t2"], None, 3]}, "ignored": {"no": 1}},
        "list": [{"props": {}}, [{"k": [{"deep": 1.0}]}], "s", None],
        "a/b": {"x": 1},
    },
    "refs": {"p": "t", "q": [], "n": None},
}


def test_links_and_tables(spark):
    payloads = spark.createDataFrame([(1, json.dumps(BODY)), (1, json.dumps(BODY)), (2, json.dumps({"refs": {"p": "t"}}))], SCHEMA)
    rows, _ = shared_inlining(payloads)
    assert set_of(node_links(rows)) == brute(1, BODY) | brute(2, {"refs": {"p": "t"}})


def test_foreign_keys_lead_to_rows(spark):
    rows, decisions = shared_inlining(spark.createDataFrame([(1, json.dumps(BODY))], SCHEMA))
    own = {r.element for r in decisions.collect() if r.own_table}
    assert own == {"list", "k"}  # both lie in lists, the others have one parent
    found = rows.collect()
    keys = {(r.record_id, r.table_name, r.row_path) for r in found}
    assert all((r.record_id, r.parent_table, r.parent_path) in keys for r in found if r.table_name)
    record = next(r for r in found if not r.table_name)
    cells = {c.key: c.value for c in record.cells}
    assert cells["name"] == "x" and cells["box/inner/a"] == "1" and cells["box/inner/b/c"] is None


def test_sent_and_joined_decisions_agree(spark):
    payloads = spark.createDataFrame([(i, json.dumps({"props": {"a": [{"b": {"a": {"c": i}}}]}, "refs": {"r": "x"}})) for i in range(5)], SCHEMA)
    sent, _ = shared_inlining(payloads)
    joined, _ = shared_inlining(payloads, max_sent=0)
    assert set_of(node_links(sent)) == set_of(node_links(joined))
    keys = lambda df: {(r.record_id, r.table_name, r.row_path, r.parent_path) for r in df.collect()}
    assert keys(sent) == keys(joined)


def test_shared_and_recursive_elements(spark):
    body = {"props": {"x": {"s": {"t": {}}}, "y": {"s": {}}, "r": {"r": {"r": {}}}}}
    graph = schema_graph(document_nodes(spark.createDataFrame([(1, json.dumps(body))], SCHEMA)))
    assert {r.element: r.reason for r in decide(graph).collect()} == {"x": "inlined", "y": "inlined", "s": "shared", "t": "inlined", "r": "recursive"}


def test_odd_bodies(spark):
    deep = '{"props":{"d":' + '{"d":' * 3000 + "1" + "}" * 3000 + "}}"
    bodies = [None, "", "no json", "[1]", '"text"', "{}", '{"props": null, "refs": null}', '{"props": [1], "refs": "x"}', '{"props": {"x": NaN}}', '{"props": {"x": {"y": 1}', '{"props": {"s": "\\ud800", "o": {"\\ud800": {}}}}', deep]
    payloads = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)] + [(None, json.dumps(BODY))], SCHEMA)
    payloads = payloads.withColumns({"element": F.lit(1), "owners": F.lit("x"), "home": F.lit("y"), "refs": F.lit("z")})
    found = rows_of(node_links(shared_inlining(payloads)[0]))
    by = {}
    for r in found:
        by.setdefault(r[0], []).append(r)
    assert set(by) == {10, 11}
    assert len(by[10]) == 2 and len(by[11]) == 3000


def test_empty_table(spark):
    rows, decisions = shared_inlining(spark.createDataFrame([], SCHEMA))
    assert rows_of(node_links(rows)) == [] and rows_of(decisions) == []


def rebuilt(rows) -> dict:
    """The properties of one body, from the cells and the objects of its table rows."""
    props: dict = {}
    objects = {(r.table_name and r.row_path) for r in rows} | {i.node_path for r in rows for i in r.inlined}
    leaves = {f"{r.row_path}/{c.key}": c.value for r in rows for c in r.cells}
    assert len(leaves) == sum(len(r.cells) for r in rows)
    for path in sorted(objects - {""}) + sorted(leaves):
        at = props
        *steps, last = path.split("/")[1:]
        for s in steps:
            at = at.setdefault(s, {})
        if path in leaves:
            at[last] = leaves[path]
        else:
            at.setdefault(last, {})
    return props


def as_steps(value):
    """A parsed value with lists that hold objects as objects of their places and other values as cells."""
    holds = lambda v: isinstance(v, dict) or isinstance(v, list) and any(map(holds, v))
    if isinstance(value, dict):
        inner = (value.get("props") or {}) if "props" in value or "refs" in value else value
        return {k: as_steps(v) for k, v in inner.items()}
    if holds(value):
        return {str(i): as_steps(v) for i, v in enumerate(value)}
    return value if value is None or isinstance(value, str) else canonical(parse(json.dumps(value)))


def test_cells_and_objects_rebuild_the_body(spark):
    mixed = {"props": {"name": [["batch probe", {"x": [1, "t"]}]], "l": [True, None, [], [1, ["u"]], {"l": ["v", {}]}, [[{}, 2], "w"]], "box": {"in": ["y", {"z": None}]}, "plain": ["p", [1]]}}
    for body in (BODY["props"], mixed["props"]):
        props = {k: v for k, v in body.items() if "/" not in k}
        rows = shared_inlining(spark.createDataFrame([(1, json.dumps({"props": props}))], SCHEMA))[0].collect()
        assert rebuilt(rows) == as_steps(props)


def test_equal_names_keep_all_values(spark):
    body = {"props": {"l": [{}, "in the list"], "l/1": "beside it"}}
    rows = shared_inlining(spark.createDataFrame([(1, json.dumps(body))], SCHEMA))[0].collect()
    assert sorted(tuple(c) for r in rows for c in r.cells) == [("l/1", "beside it"), ("l/1", "in the list")]


def test_references_and_entity_keys(spark):
    inner = {"id": "i", "recorded": 5, "props": {"z": {"deleted": True}}, "refs": {"q": ["t2", ["t3"]]}}
    body = {"id": "b", "recorded": "7", "deleted": False, "props": {"box": {"in": inner}, "l": [{"deleted": True, "refs": {"q": "t4"}}]}, "refs": {"p": "t1"}}
    rows = shared_inlining(spark.createDataFrame([(1, json.dumps(body))], SCHEMA))[0]
    assert set_of(references(rows).drop("delivery")) == {
        (1, "", "", "", "p", "/@refs/p", "t1"),
        (1, "", "", "/box/in", "q", "/box/in/@refs/q/0", "t2"),
        (1, "", "", "/box/in", "q", "/box/in/@refs/q/1/0", "t3"),
        (1, "l", "/l/0", "/l/0", "q", "/l/0/@refs/q", "t4"),
    }
    assert set_of(entities(rows).drop("delivery")) == {(1, "", "", "", "b", "7", "false"), (1, "", "", "/box/in", "i", "5", None), (1, "l", "/l/0", "/l/0", None, None, "true")}
    assert {(r.table_name, r.recorded, r.deleted) for r in rows.collect()} == {("", "7", "false"), ("l", None, "true")}
