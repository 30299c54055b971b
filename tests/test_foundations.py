import json
import random

import pytest
from pyspark.sql import functions as F

from strandlog import jsoncanon
from strandlog.functions import access, entity, uri
from strandlog.identity import Namespaces, uri_head, uri_tail
from strandlog.model import change_table, content_key, prop_texts, ref_pairs
from strandlog.ordering import number_rows, with_previous

from .conftest import rows_of, set_of


def test_deep_parser_agrees_with_the_plain_one():
    texts = ['{"a":[1,2.50,{"b":null}],"c":"\\u00e9\\"x"}', "[]", "{}", "[[],{},[{}]]", " [1 , 2 ] ", '"s"', "-0.5e3", "true", "null", '{"a":1,"a":2}']
    for t in texts:
        assert jsoncanon._parse_deep(t) == jsoncanon.parse(t)
        assert jsoncanon._write_deep(jsoncanon.parse(t)) == jsoncanon.canonical(jsoncanon.parse(t))
    for bad in ["", "{", "[1,]", '{"a"}', '{"a":}', "[1 2]", "nul", "01", "1.", "[1]x", '{"a":1,}', "{1:2}", '"x', "NaN", "Infinity"]:
        with pytest.raises(ValueError):
            jsoncanon.parse(bad)
        with pytest.raises(ValueError):
            jsoncanon._parse_deep(bad)


def test_very_deep_and_very_long_values():
    deep = "[" * 100_000 + "]" * 100_000
    assert jsoncanon.canonical(jsoncanon.parse(deep)) == deep
    assert jsoncanon.parse("9" * 5000) == float("inf")
    assert jsoncanon.canonical_content(None, None) == jsoncanon.canonical_content("{}", " { } ")


def test_namespaces_inline_and_joined_agree(spark):
    table = [("p", "http://a.invalid/x/", 2), ("q", "http://a.invalid/x#", 1), ("r", "http://a.invalid/", 0), ("s", "http://a.invalid/x/", 1), ("t", None, 9)]
    names = Namespaces(spark.createDataFrame(table, "prefix string, expansion string, ord int"))
    ids = ["http://a.invalid/x/1", "http://a.invalid/x#1", "http://a.invalid/x/y#1", "http://a.invalid/z", "p:1", "", None, "http://other.invalid/1", "a/b#c/d", "http://a.invalid/x/"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    inline = set_of(names.compress(df.withColumn("out", F.col("id")), "out"))
    names._inline = None
    joined = set_of(names.compress(df.withColumn("out", F.col("id")), "out"))
    assert inline == joined
    assert dict(inline) == {
        "http://a.invalid/x/1": "s:1", "http://a.invalid/x#1": "q:1", "http://a.invalid/x/y#1": "http://a.invalid/x/y#1", "http://a.invalid/z": "r:z", "p:1": "p:1",
        "": "", None: None, "http://other.invalid/1": "http://other.invalid/1", "a/b#c/d": "a/b#c/d", "http://a.invalid/x/": "s:",
    }


def test_uri_parts(spark):
    df = spark.createDataFrame([("http://a/b#c",), ("http://a/b",), ("x",), ("a#b/c",)], "u string")
    assert rows_of(df.select(uri_head(F.col("u")), uri_tail(F.col("u")))) == [("http://a/b#", "c"), ("http://a/", "b"), ("", "x"), ("a#", "b/c")]


def test_ref_pairs_and_prop_texts(spark):
    refs = ['{"p":"a","q":["b","c"],"n":null,"e":[],"m":[null,"d",1],"o":{"x":"y"},"s":"[\\"z\\"]","k":5}', "broken", None, "[]", "{}"]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    got = [sorted((x.predicate, x.target) for x in r[0]) if r[0] is not None else None for r in df.select(ref_pairs(F.col("r"))).collect()]
    assert got[0] == [("m", "d"), ("p", "a"), ("q", "b"), ("q", "c"), ("s", '["z"]')] and not any(got[1:])
    props = df.select(prop_texts(F.lit('{"a": 1.0, "b": null, "c": "x", "d": [1, {"z": 2, "y": 1}]}')).alias("p")).first().p
    assert props == {"a": "1", "c": '"x"', "d": '[1,{"y":1,"z":2}]'}


# One pair of versions per line: what differs, and whether they are the same content
EQUALITY = [
    ('{"a":"x"}', '{"a":"x"}', True), ('{"a":1}', '{"a":1.0}', True), ('{"a":true}', '{"a":true}', True), ('{"a":["x",1]}', '{"a":["x",1.0]}', True),
    ('{"a":{"props":{"b":1}}}', '{"a":{"props":{"b":1.0}}}', True), ('{"a":null}', '{"a":null}', True), ('{"a":[null]}', '{"a":[null]}', True),
    ('{"a":1}', '{"a":1,"b":2}', False), ('{"a":1}', "{}", False), ('{"a":1}', '{"a":2}', False), ('{"a":"1"}', '{"a":1}', False), ('{"a":"x"}', '{"a":["x"]}', False),
    ('{"a":["x"]}', '{"a":true}', False), ('{"a":["x","y"]}', '{"a":["x","z"]}', False), ('{"a":{"props":{"b":1}}}', '{"a":{"props":{"b":2}}}', False), ('{"a":null}', '{"a":8}', False),
]


def test_entity_equality(spark):
    rows = [(i, s, False, p, "{}") for i, (a, b, _) in enumerate(EQUALITY) for s, p in ((0, a), (1, b))]
    n = len(EQUALITY)
    rows += [(n, 0, False, "{}", "{}"), (n, 1, True, "{}", "{}")]
    rows += [(n + 1, 0, False, "{}", '{"r":"a"}'), (n + 1, 1, False, "{}", '{"r":["a"]}')]
    rows += [(n + 2, 0, False, "{}", '{"r":"a"}'), (n + 2, 1, False, "{}", '{"r":"b"}')]
    keyed = content_key(spark.createDataFrame(rows, "i int, side int, deleted boolean, props string, refs string"))
    same = {r.i: r.n == 1 for r in keyed.groupBy("i").agg(F.countDistinct("content_key").alias("n")).collect()}
    assert same == {**{i: e[2] for i, e in enumerate(EQUALITY)}, n: False, n + 1: False, n + 2: False}


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_ordered_operations_over_partition_edges(spark, parts):
    rng = random.Random(int(parts))
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, f"v{i}") for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v string")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.g, r.o): r.before for r in with_previous(df, ["g"], ["o"], "v", "before").collect()}
        nth = {(r.g, r.o): r.nth for r in number_rows(df, "g", ["o"], "nth").collect()}
        assert got == {(r.g, r.o): r.before for r in with_previous(df, ["g"], ["o"], "v", "before", at_most=400).collect()}
        assert nth == {(r.g, r.o): r.nth for r in number_rows(df, "g", ["o"], "nth", at_most=400).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    for g in ("hot", "a", "b", None):
        mine = sorted(o for x, o, _ in rows if x == g)
        assert [got[g, o] for o in mine] == [None, *(f"v{o}" for o in mine[:-1])]
        assert [nth[g, o] for o in mine] == list(range(len(mine)))


def test_change_table(spark, namespaces):
    raw = [("d", 1, "http://x.invalid/people/1", 5, None, None, None, None), ("d", 1, "ns3:1", 5, 0, False, "{}", "{}"), (None, 2, "x", 1, 1, None, None, None), ("d", 2, None, 1, 1, None, None, None)]
    df = spark.createDataFrame(raw, "dataset string, seq bigint, id string, recorded bigint, batch_seq int, deleted boolean, props string, refs string")
    assert rows_of(change_table(df, namespaces)) == [("d", 1, "ns3:1", 5, 0, False, "{}", "{}")]


def test_helpers(spark):
    df = spark.createDataFrame([("e1", False, '{"a:x":1,"a:y":"two"}', '{"a:r":["t"],"a:s":"u"}')], "entity_id string, deleted boolean, props string, refs string")
    t = entity.typed(df)
    one = lambda c: t.select(c).first()[0]
    p, r = F.col("props"), F.col("refs")
    assert one(entity.set_property(p, "a", "x", F.lit("9"))) == {"a:x": "9", "a:y": '"two"'}
    assert one(entity.get_property(p, "a", "z", F.lit("d"))) == "d" and one(entity.get_property(p, "a", "z")) is None
    assert one(entity.add_reference(r, "a", "r", F.array(F.lit("n")))) == {"a:r": ["n"], "a:s": ["u"]}
    assert one(entity.get_reference(r, "a", "s")) == ["u"]
    assert one(entity.rename_property(p, "a", "x", "b", "n")) == {"b:n": "1", "a:y": '"two"'}
    assert one(entity.rename_property(p, "a", "none", "b", "n")) == {"a:x": "1", "a:y": '"two"'}
    assert one(entity.rename_property(p, "a", "x", "a", "y")) == {"a:y": "1"}
    assert one(entity.remove_property(p, "a", "x")) == {"a:y": '"two"'}
    assert one(entity.prefix_field("a", "b")) == "a:b"
    new = entity.new_entity_from(t, "x:T", copy_props=True).first()
    assert (new.entity_id, new.deleted, new.props, new.refs) == ("e1", False, {"a:x": "1", "a:y": '"two"'}, {"rdf:type": ["x:T"]})
    assert entity.new_entity_from(t, copy_refs=True).first().refs == {"a:r": ["t"], "a:s": ["u"]}
    back = entity.stored(t).first()
    assert (back.props, back.refs) == (df.first().props, df.first().refs)
    assert len(one(entity.new_uuid())) == 36


def test_to_string(spark):
    cases = [(None, "undefined"), ("30", "30"), ("30.0", "30"), ("2.1", "2.1"), ("true", "true"), ('"a\\"b"', 'a"b'), ("[1]", "[1]"), ("-5", "-5"), ('""', "")]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string")
    assert [r[0] for r in df.select(entity.to_string(F.col("v"))).collect()] == [c[1] for c in cases]


def test_as_entity(spark):
    cases = ['{"id":"x","props":{"a":1},"refs":{"b":"c"},"deleted":true}', '{"props":{}}', "[1]", '"s"', '{"other":1}', None, "broken"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "v string").select(entity.as_entity(F.col("v"))).collect()]
    assert tuple(got[0]) == ("x", True, '{"a":1}', '{"b":"c"}') and tuple(got[1]) == (None, False, "{}", "{}") and got[2:] == [None] * 5


def test_prefix_table():
    t = uri.PrefixTable([("ns0", "http://core.invalid/")])
    assert t.assert_prefix("http://a.invalid/") == "ns1" == t.assert_prefix("http://a.invalid/") == t.prefix("http://a.invalid/")
    assert t.canonical("http://a.invalid/b#c", {}) == "ns2:c" and t.canonical("x:1", {"x": "http://a.invalid/"}) == "ns1:1" and t.canonical("1", {"_": "http://a.invalid/"}) == "ns1:1"
    for bad in ("", "q:1", "1"):
        with pytest.raises(ValueError, match="identifier|expansion"):
            t.canonical(bad, {})
    t.assert_prefix("urn:x")
    assert "urn:x" not in t.context(strict=True)["namespaces"].values() and t.context(["http://a.invalid/"])["namespaces"] == {"ns1": "http://a.invalid/"}
    assert t.rows()[0] == ("ns0", "http://core.invalid/", 0)


def test_expand_identifiers(spark):
    df = entity.typed(spark.createDataFrame([("a:1", '{"a:x":1}', '{"a:r":["a:2","b:3"],"a:s":"a:4"}')], "entity_id string, props string, refs string"))
    r = uri.expand_identifiers(df, {"a": "http://a.invalid/"}).first()
    assert (r.entity_id, r.props, r.refs) == ("http://a.invalid/1", {"http://a.invalid/x": "1"}, {"http://a.invalid/r": ["http://a.invalid/2", "b:3"], "http://a.invalid/s": ["a:4"]})
    ids = spark.createDataFrame([("a:1",), ("b:1",), ("plain",), (None,)], "id string")
    names = spark.createDataFrame([("a", "http://a.invalid/", 0)], "prefix string, expansion string, ord int")
    assert {r.id: r.full for r in uri.expand_curie(ids, "id", names, "full").collect()} == {"a:1": "http://a.invalid/1", "b:1": "b:1", "plain": "plain", None: None}
    assert [r[0] for r in ids.select(uri.local_name(F.col("id"))).collect()] == ["1", "1", "plain", None]


def test_access():
    rules = [access.Rule("/datasets/a*"), access.Rule("/datasets/b", "write"), access.Rule("/datasets/ab", deny=True)]
    assert access.allowed(rules, "/datasets/abc", "read") and not access.allowed(rules, "/datasets/abc", "write")
    assert access.allowed(rules, "/datasets/b", "read") and access.allowed(rules, "/datasets/b", "write") and not access.allowed(rules, "/datasets/b/x", "read")
    assert access.allowed(rules, "/datasets/ab", "read")  # a denial takes nothing away
    assert [access.action_of(m) for m in ("GET", "post", "PUT", "PATCH", "DELETE", "HEAD")] == ["read", "write", "write", "write", "write", "read"]


def test_access_as_filter(spark):
    names = ["a1", "ab", "b", "bx", "c", None]
    df = spark.createDataFrame([(n,) for n in names], "dataset string")
    rules = [access.Rule("/datasets/a*"), access.Rule("/datasets/b", "write")]
    for action in ("read", "write"):
        got = {r.dataset for r in access.visible_datasets(df, rules, action).collect()}
        assert got == {n for n in names if n and access.allowed(rules, f"/datasets/{n}", action)}
    assert json.dumps(sorted(got)) == '["b"]'


def test_one_namespace_rule_for_all_sizes(spark):
    """The spelling is the same whether the table is part of the expression or joined."""
    rows = [("b", "http://x/", None), ("a", "http://x/", None), ("d", "http://y#", 2), ("c", "http://y#", 2), ("z", "http://y#", 1), ("e", "http://z/", None), ("f", "http://z/", 9), ("n", "", 0)]
    table = spark.createDataFrame(rows, "prefix string, expansion string, ord int")
    ids = spark.createDataFrame([(x,) for x in ("http://x/1", "http://y#2", "http://z/3", "http://no/4", "plain", "a:5", None)], "id string")
    few, many = Namespaces(table), Namespaces(table, inline=1)
    assert few._inline is not None and many._inline is None
    want = ["a:1", "z:2", "f:3", "http://no/4", "plain", "a:5", None]
    for names in (few, many):
        assert [r.c for r in sorted(names.compress(ids.withColumn("c", F.col("id")), "c").collect(), key=lambda r: [x.id for x in ids.collect()].index(r.id))] == want
    curies = spark.createDataFrame([("a:1",), ("c:2",), ("e:3",)], "id string")
    twice = table.unionByName(spark.createDataFrame([("c", "http://w/", None), ("e", "http://a/", None)], "prefix string, expansion string, ord int"))
    assert {r.full for r in uri.expand_curie(curies, "id", twice, "full").collect()} == {"http://x/1", "http://y#2", "http://a/3"}
