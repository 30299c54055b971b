"""Queries of the entity-store operators over the change log, with their oracles."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, entity, uri
from ..identity import Namespaces
from ..model import change_table, ref_pairs
from ..operators import graph, incremental, maintenance, mutation, snapshot
from ..sources import formats
from ..sources.readers import SampleSource, UnionDatasetSource
from ..session import keep_path, materialise
from ..store import EntityStore
from ..tables import load
from . import stars
from .pipeline import JobState, Pipeline, per_batch
from .problems import curie_sql
from .query import Query, paged_query

#: A moment within the log: 2025-01-01 in nanoseconds.
AT = 1_735_689_600_000_000_000
#: The offset that incremental queries go on from.
SINCE = 200
#: Rows of a page.
PAGE = 50

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle if SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def _ns(spark: SparkSession, d: str) -> Namespaces:
    return Namespaces(load(spark, d, "namespace_map"))


def _log(spark: SparkSession, d: str, distinct: bool = False) -> DataFrame:
    return change_table(load(spark, d, "change_log"), _ns(spark, d), distinct)


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dataset_catalog").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def _links(spark: SparkSession, d: str, at: int | None = None) -> DataFrame:
    return graph.relations(_log(spark, d), _ns(spark, d), at)


def _subjects(links: DataFrame) -> DataFrame:
    return links.select(F.col("subject").alias("start_id")).distinct()


def _sites(spark: SparkSession, d: str) -> list[str]:
    """All sites that have a person dataset."""
    names = load(spark, d, "change_log").where("dataset LIKE '%.person'").select("dataset").distinct().collect()
    return sorted(r.dataset.rsplit(".", 1)[0] for r in names)


def _site(spark: SparkSession, d: str) -> str:
    """The first site that has a person dataset."""
    return load(spark, d, "change_log").where("dataset LIKE '%.person'").agg(F.min("dataset")).first()[0].rsplit(".", 1)[0]


# Oracle parts

_VERS = f"""vers AS (
  SELECT DISTINCT dataset, seq, {curie_sql('id')} AS entity_id, recorded, batch_seq, coalesce(deleted, false) AS deleted, coalesce(props, '{{}}') AS props, coalesce(refs, '{{}}') AS refs FROM change_log
)"""


def _newest(name: str, source: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY dataset, entity_id ORDER BY recorded DESC, batch_seq DESC, seq DESC) AS n FROM {source}) WHERE n = 1)"


def _rels(name: str, source: str) -> str:
    return f"""{name} AS (
  WITH k AS (SELECT dataset, entity_id, recorded, refs, unnest(json_keys(refs)) AS p FROM {source} WHERE NOT deleted),
  v AS (SELECT dataset, entity_id, recorded, p, json_extract(refs, '$."' || p || '"') AS x FROM k),
  t AS (
    SELECT dataset, entity_id, recorded, p, x ->> '$' AS o FROM v WHERE json_type(x) = 'VARCHAR'
    UNION
    SELECT dataset, entity_id, recorded, p, e ->> '$' FROM (SELECT dataset, entity_id, recorded, p, unnest(CAST(x AS JSON[])) AS e FROM v WHERE json_type(x) = 'ARRAY') WHERE json_type(e) = 'VARCHAR'
  )
  SELECT DISTINCT dataset, entity_id AS subject, {curie_sql('p')} AS predicate, {curie_sql('o')} AS object, recorded FROM t
)"""


_LATEST = f"{_VERS}, {_newest('latest', 'vers')}"
_LINKS = f"{_LATEST}, {_rels('rels', 'latest')}"
_OLD = f"old AS (SELECT * FROM vers WHERE recorded <= {AT}), {_newest('latest_at', 'old')}"
_SITE = "(SELECT regexp_replace(min(dataset), '\\.[^.]*$', '') FROM change_log WHERE dataset LIKE '%.person')"
# JSON values as text with numbers in their shortest form, names sorted
_PROPS = r"""coalesce((SELECT string_agg(q.k || '=' || regexp_replace(regexp_replace(CAST(json_extract({c}, '$."' || q.k || '"') AS VARCHAR), '(\.[0-9]*[1-9])0+([,}}\]]|$)', '\1\2', 'g'), '\.0+([,}}\]]|$)', '\1', 'g'), ';' ORDER BY q.k)
  FROM (SELECT unnest(json_keys({c})) AS k) q WHERE json_type({c}, '$."' || q.k || '"') <> 'NULL'), '')"""
_TEXT = r"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '(\.[0-9]*[1-9])0+([,}}\]]|$)', '\1\2', 'g'), '\.0+([,}}\]]|$)', '\1', 'g')"
# every property of live newest versions with its value as text
_VALUES = f"""keyed AS (SELECT *, unnest(json_keys(props)) AS name FROM latest WHERE NOT deleted), told AS (SELECT *, json_extract(props, '$."' || name || '"') AS x FROM keyed),
v AS (SELECT dataset, entity_id, deleted, props, name, {_TEXT.format(x='x')} AS value FROM told WHERE json_type(x) <> 'NULL')"""
_KEY = "concat_ws('|', deleted, " + _PROPS.format(c="props") + ", " + _PROPS.format(c="refs") + ")"


# Scans, feeds and versions


@query(f"WITH {_LATEST} SELECT dataset, entity_id, seq, recorded, CAST(batch_seq AS BIGINT) AS batch_seq, deleted FROM latest")
def entities_latest(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.latest(_log(spark, d), payload=()).select("dataset", "entity_id", "seq", "recorded", "batch_seq", "deleted")


@query(f"WITH {_VERS}, {_OLD} SELECT dataset, entity_id, seq, recorded, deleted FROM latest_at")
def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.latest(_log(spark, d), AT, payload=()).select("dataset", "entity_id", "seq", "recorded", "deleted")


@query(f"WITH {_VERS} SELECT dataset, seq, entity_id, recorded FROM vers WHERE seq >= {SINCE}")
def changes_since(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d, distinct=True).where(F.col("seq") >= SINCE).select("dataset", "seq", "entity_id", "recorded")


@query(f"WITH {_LATEST} SELECT dataset, seq, entity_id FROM latest WHERE seq >= {SINCE}")
def changes_latest_only(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.latest_only(_log(spark, d, distinct=True)).where(F.col("seq") >= SINCE).select("dataset", "seq", "entity_id")


@query(f"WITH {_VERS} SELECT dataset, seq, entity_id FROM vers WHERE dataset = {_SITE} || '.person' ORDER BY seq DESC LIMIT {PAGE}")
def changes_reverse(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.feed(_log(spark, d, distinct=True), _site(spark, d) + ".person", limit=PAGE, reverse=True).select("dataset", "seq", "entity_id")


@query(f"WITH {_VERS} SELECT dataset, seq, entity_id FROM vers WHERE dataset = {_SITE} || '.person' AND seq >= {SINCE} ORDER BY seq LIMIT {PAGE}")
def changes_page(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.feed(_log(spark, d, distinct=True), _site(spark, d) + ".person", SINCE, PAGE).select("dataset", "seq", "entity_id")


@query("SELECT dataset, max(seq) + 1 AS next_offset FROM change_log GROUP BY dataset")
def changes_watermark(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.watermark(load(spark, d, "change_log"))


@query(f"WITH {_LATEST} SELECT entity_id, dataset, recorded FROM latest WHERE entity_id > 'ns5:' AND dataset = {_SITE} || '.device' ORDER BY entity_id LIMIT {PAGE}")
def entities_page(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot.latest(_log(spark, d).where(F.col("dataset") == _site(spark, d) + ".device"), payload=())
    return snapshot.entity_page(rows, "ns5:", PAGE).select("entity_id", "dataset", "recorded")


@query(
    f"""WITH {_VERS}, f AS (SELECT dataset, entity_id, seq, row_number() OVER w AS a, lead(seq) OVER w IS NULL AS is_last FROM vers
WINDOW w AS (PARTITION BY dataset, entity_id ORDER BY recorded, batch_seq, seq)) SELECT dataset, entity_id, seq, a = 1 AS is_first, is_last FROM f"""
)
def version_flags(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.version_flags(_log(spark, d, distinct=True))


@query(f"WITH {_LATEST} SELECT dataset, count(*) AS entities FROM latest WHERE dataset NOT IN (SELECT dataset FROM dataset_catalog WHERE deleted) GROUP BY dataset")
def deleted_dataset_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot.in_scope(_log(spark, d), _catalog(spark, d))
    return maintenance.item_counts(rows).select("dataset", F.col("items").alias("entities"))


@query(f"WITH {_VERS} SELECT dataset, count(DISTINCT entity_id) AS items FROM vers WHERE dataset = {_SITE} || '.person' GROUP BY dataset")
def dataset_scope(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.item_counts(snapshot.in_scope(_log(spark, d), _catalog(spark, d), [_site(spark, d) + ".person", "no.such"]))


# Properties


@query(f"WITH {_LATEST} SELECT dataset, entity_id, CAST(json_extract(props, '$.\"ns5:reading\"') AS DOUBLE) AS reading FROM latest WHERE NOT deleted AND CAST(json_extract(props, '$.\"ns5:reading\"') AS DOUBLE) > 500")
def property_filter(spark: SparkSession, d: str) -> DataFrame:
    reading = F.try_variant_get(F.try_parse_json("props"), '$["ns5:reading"]', "double")
    return snapshot.latest(_log(spark, d), include_deleted=False, payload=("props",)).select("dataset", "entity_id", reading.alias("reading")).where("reading > 500")


@query(
    f"""WITH {_LATEST} SELECT json_extract_string(props, '$."ns5:state"') AS state, count(*) AS n, count(DISTINCT dataset) AS n_datasets,
CAST(sum(CAST(CAST(json_extract(props, '$."ns5:reading"') AS DOUBLE) AS DECIMAL(18, 3))) * 1000 AS BIGINT) AS sum_thousandths FROM latest WHERE NOT deleted AND dataset LIKE '%.device' GROUP BY 1"""
)
def property_group(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    rows = snapshot.latest(_log(spark, d).where(F.col("dataset").endswith(".device")), include_deleted=False, payload=("props",))
    rows = rows.select("dataset", F.try_variant_get(v, '$["ns5:state"]', "string").alias("state"), F.try_variant_get(v, '$["ns5:reading"]', "double").alias("reading"))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dataset").alias("n_datasets"), (F.sum(F.col("reading").cast("decimal(18,3)")) * 1000).cast("bigint").alias("sum_thousandths"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return entity.typed(snapshot.latest(_log(spark, d), include_deleted=False))


def _entries(rows: DataFrame, props) -> DataFrame:
    return rows.select("dataset", "entity_id", F.explode(props).alias("name", "value"))


@query(f"WITH {_LATEST}, {_VALUES} SELECT dataset, entity_id, CASE name WHEN 'ns3:name' THEN 'ns3:title' ELSE name END AS name, value FROM v WHERE name <> 'ns3:title' OR NOT list_contains(json_keys(props), 'ns3:name')")
def props_rename(spark: SparkSession, d: str) -> DataFrame:
    return _entries(_typed(spark, d), entity.rename_property(F.col("props"), "ns3", "name", "ns3", "title"))


@query(f"WITH {_LATEST}, {_VALUES} SELECT dataset, entity_id, name, value FROM v WHERE name <> 'ns5:label'")
def props_remove(spark: SparkSession, d: str) -> DataFrame:
    return _entries(_typed(spark, d), entity.remove_property(F.col("props"), "ns5", "label"))


@query(f"WITH {_LATEST} SELECT dataset, entity_id, coalesce(json_extract_string(props, '$.\"ns3:name\"'), 'nobody') AS name, 'yes' AS seen FROM latest WHERE NOT deleted")
def props_get_set(spark: SparkSession, d: str) -> DataFrame:
    props = entity.set_property(F.col("props"), "ns3", "seen", F.lit('"yes"'))
    name = entity.to_string(entity.get_property(props, "ns3", "name", F.lit('"nobody"')))
    return _typed(spark, d).select("dataset", "entity_id", name.alias("name"), entity.to_string(entity.get_property(props, "ns3", "seen")).alias("seen"))


@query(f"WITH {_LATEST}, {_VALUES} SELECT entity_id, deleted, name, value FROM v UNION ALL SELECT entity_id, deleted, 'rdf:type', '[\"ns2:thing\"]' FROM latest WHERE NOT deleted")
def new_entity_from(spark: SparkSession, d: str) -> DataFrame:
    rows = entity.new_entity_from(_typed(spark, d), add_type="ns2:thing", copy_props=True)
    refs = F.transform_values("refs", lambda k, v: F.to_json(v))
    return rows.select("entity_id", "deleted", F.explode(F.map_concat("props", refs)).alias("name", "value"))


@query(
    f"""WITH {_LATEST}, w AS (SELECT dataset, entity_id, refs, json_extract(refs, '$."ns4:worksfor"') AS x FROM latest WHERE NOT deleted)
SELECT dataset, entity_id, true AS deleted, 'ns2:a,ns2:b' AS tags, CASE WHEN x IS NULL OR json_type(x) = 'NULL' THEN 'nobody' WHEN json_type(x) = 'ARRAY' THEN array_to_string(CAST(x AS VARCHAR[]), ',') ELSE x ->> '$' END AS worksfor FROM w"""
)
def refs_get_add(spark: SparkSession, d: str) -> DataFrame:
    refs = entity.add_reference(F.col("refs"), "ns2", "tag", F.array(F.lit("ns2:a"), F.lit("ns2:b")))
    works = entity.get_reference(refs, "ns4", "worksfor", F.array(F.lit("nobody")))
    return _typed(spark, d).select("dataset", "entity_id", entity.set_deleted(True).alias("deleted"), F.array_join(entity.get_reference(refs, "ns2", "tag"), ",").alias("tags"), F.array_join(works, ",").alias("worksfor"))


@query(f"WITH {_LATEST} SELECT dataset, count(*) AS n_uuids, 36 AS width FROM latest GROUP BY dataset")
def uuids(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(snapshot.latest(_log(spark, d), payload=()).select("dataset", entity.new_uuid().alias("u")), "uuids")
    return rows.groupBy("dataset").agg(F.countDistinct("u").alias("n_uuids"), F.max(F.length("u")).alias("width"))


@query(
    f"""WITH {_LATEST} SELECT dataset, entity_id, coalesce(json_extract_string(props, '$."ns3:name"'), 'undefined') AS name, coalesce(CAST(CAST(json_extract(props, '$."ns3:age"') AS BIGINT) AS VARCHAR), 'undefined') AS age,
coalesce(json_extract_string(props, '$."ns5:up"'), 'undefined') AS up FROM latest WHERE NOT deleted"""
)
def to_string(spark: SparkSession, d: str) -> DataFrame:
    p = lambda n: F.try_element_at("props", F.lit(n))
    return _typed(spark, d).select("dataset", "entity_id", entity.to_string(p("ns3:name")).alias("name"), entity.to_string(p("ns3:age")).alias("age"), entity.to_string(p("ns5:up")).alias("up"))


@query(f"WITH {_LATEST} SELECT dataset, entity_id, json_extract_string(props, '$.\"ns4:seat\".props.\"ns8:town\"') AS town FROM latest WHERE NOT deleted AND json_type(props, '$.\"ns4:seat\"') = 'OBJECT'")
def as_entity(spark: SparkSession, d: str) -> DataFrame:
    nested = entity.as_entity(F.try_element_at("props", F.lit("ns4:seat")))
    town = F.try_variant_get(F.try_parse_json("e.props"), '$["ns8:town"]', "string")
    return _typed(spark, d).select("dataset", "entity_id", nested.alias("e")).where("e IS NOT NULL").select("dataset", "entity_id", town.alias("town"))


@query(f"WITH {_LATEST}, n AS (SELECT dataset, upper(json_extract_string(props, '$.\"ns5:label\"')) AS label FROM latest WHERE NOT deleted) SELECT dataset, label, count(*) AS n FROM n WHERE label IS NOT NULL GROUP BY 1, 2")
def user_transform(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot.latest(_log(spark, d), include_deleted=False, payload=("props",)).select("dataset", F.try_variant_get(F.try_parse_json("props"), '$["ns5:label"]', "string").alias("label"))
    out = per_batch(lambda pdf: pdf.assign(label=pdf.label.str.upper()), "dataset string, label string")(rows)
    return out.where("label IS NOT NULL").groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


# Identifiers


@query(
    r"""SELECT DISTINCT id, CASE WHEN id LIKE '%#%' THEN regexp_extract(id, '^(.*#)', 1) WHEN id LIKE '%/%' THEN regexp_extract(id, '^(.*/)', 1) ELSE '' END AS expansion,
CASE WHEN id LIKE '%#%' THEN regexp_extract(id, '[^#]*$') WHEN id LIKE '%/%' THEN regexp_extract(id, '[^/]*$') ELSE id END AS name FROM change_log"""
)
def uri_split(spark: SparkSession, d: str) -> DataFrame:
    parts = uri.url_parts(F.col("id"))
    return load(spark, d, "change_log").select("id").distinct().select("id", parts["expansion"].alias("expansion"), parts["name"].alias("name"))


@query(f"WITH {_VERS}, i AS (SELECT DISTINCT entity_id FROM vers) SELECT entity_id, coalesce(n.expansion || substr(entity_id, length(n.prefix) + 2), entity_id) AS full_uri FROM i LEFT JOIN namespace_map n ON n.prefix = split_part(entity_id, ':', 1) AND entity_id LIKE '%:%'")
def curie_expand(spark: SparkSession, d: str) -> DataFrame:
    ids = _log(spark, d).select("entity_id").distinct()
    return uri.expand_curie(ids, "entity_id", load(spark, d, "namespace_map"), "full_uri").select("entity_id", "full_uri")


@query(f"WITH {_LATEST}, {_VALUES}, full_ids AS (SELECT dataset, coalesce(n.expansion || substr(entity_id, length(n.prefix) + 2), entity_id) AS entity_id, name FROM v LEFT JOIN namespace_map n ON n.prefix = split_part(entity_id, ':', 1) AND entity_id LIKE '%:%') SELECT dataset, entity_id, coalesce(n.expansion || substr(name, length(n.prefix) + 2), name) AS name FROM full_ids LEFT JOIN namespace_map n ON n.prefix = split_part(name, ':', 1) AND name LIKE '%:%'")
def identifiers_expanded(spark: SparkSession, d: str) -> DataFrame:
    table = {r.prefix: r.expansion for r in load(spark, d, "namespace_map").limit(1_000).collect()}
    rows = uri.expand_identifiers(_typed(spark, d), table)
    return rows.select("dataset", "entity_id", F.explode(F.map_keys("props")).alias("name"))


@query("SELECT 'ns' || (row_number() OVER (ORDER BY min(ord)) - 1) AS prefix, expansion FROM namespace_map GROUP BY expansion")
def prefixes_asserted(spark: SparkSession, d: str) -> DataFrame:
    """The prefixes that an empty table gives the expansions, asked for in order and then again."""
    expansions = [r.expansion for r in load(spark, d, "namespace_map").groupBy("expansion").agg(F.min("ord").alias("o")).orderBy("o").limit(1_000).collect()]
    table = uri.PrefixTable()
    given = [table.assert_prefix(e) for e in expansions]
    return spark.createDataFrame([(table.assert_prefix(e), e) for e in expansions if table.prefix(e) in given], "prefix string, expansion string")


@query("SELECT prefix, expansion, ord FROM namespace_map ORDER BY ord")
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "namespace_map").orderBy("ord").select("prefix", "expansion", "ord")


@query("SELECT c.dataset, n.prefix, n.expansion FROM dataset_catalog c, namespace_map n WHERE c.public_namespaces IS NULL OR len(c.public_namespaces) = 0 OR list_contains(c.public_namespaces, n.expansion)")
def public_context(spark: SparkSession, d: str) -> DataFrame:
    """The context each dataset shows: its public namespaces, all if it lists none."""
    rows = load(spark, d, "dataset_catalog").select("dataset", "public_namespaces")
    # every namespace with every dataset is the result itself for datasets without a list
    every = uri.bounded_rows(load(spark, d, "namespace_map"))
    shown = F.when(F.coalesce(F.size("public_namespaces"), F.lit(0)) <= 0, every).otherwise(F.filter(every, lambda n: F.array_contains("public_namespaces", n["expansion"])))
    return rows.select("dataset", F.explode(shown).alias("n")).select("dataset", "n.prefix", "n.expansion")


# Graph


@query(f"WITH {_LINKS} SELECT subject AS start_id, predicate, object AS related_id, max(recorded) AS recorded FROM rels WHERE predicate = 'ns4:worksfor' GROUP BY 1, 2, 3")
def outgoing_hop(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return graph.hop(_subjects(links), links, "ns4:worksfor")


@query(f"WITH {_LINKS} SELECT object AS start_id, predicate, subject AS related_id, max(recorded) AS recorded FROM rels WHERE predicate = 'ns6:device' GROUP BY 1, 2, 3")
def inverse_hop(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return graph.hop(links.select(F.col("object").alias("start_id")), links, "ns6:device", inverse=True)


@query(f"WITH {_LINKS} SELECT subject AS start_id, predicate, object AS related_id, max(recorded) AS recorded FROM rels GROUP BY 1, 2, 3")
def star_hop(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return graph.hop(_subjects(links), links)


@query(f"WITH {_VERS}, {_OLD}, {_rels('rels', 'latest_at')} SELECT object AS start_id, predicate, subject AS related_id, max(recorded) AS recorded FROM rels GROUP BY 1, 2, 3")
def inverse_hop_as_of(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d, AT)
    return graph.hop(links.select(F.col("object").alias("start_id")), links, inverse=True)


@query(f"WITH {_LINKS} SELECT subject AS start_id, predicate, object AS related_id, max(recorded) AS recorded FROM rels WHERE dataset = {_SITE} || '.person' GROUP BY 1, 2, 3")
def scoped_hop(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return graph.hop(_subjects(links), links, datasets=[_site(spark, d) + ".person"])


@query(f"WITH {_LINKS} SELECT subject, predicate, object, count(DISTINCT dataset) AS n_datasets FROM rels GROUP BY 1, 2, 3")
def relation_any_dataset(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).groupBy("subject", "predicate", "object").agg(F.countDistinct("dataset").alias("n_datasets"))


_LIVE = """ents AS (SELECT entity_id, bool_and(deleted) AS deleted, count(*) FILTER (WHERE NOT deleted) AS n_partials,
  coalesce(arg_min(recorded, dataset_id) FILTER (WHERE NOT deleted), arg_min(recorded, dataset_id)) AS recorded FROM latest LEFT JOIN (SELECT dataset, dataset_id FROM dataset_catalog) USING (dataset) GROUP BY 1)"""


@query(
    f"""WITH {_LINKS}, {_LIVE}, h AS (SELECT DISTINCT subject AS start_id, predicate, object AS related_id FROM rels)
SELECT start_id, predicate, related_id, coalesce(recorded, 0) AS entity_recorded, coalesce(deleted, false) AS deleted, recorded IS NOT NULL AS resolved FROM h LEFT JOIN ents ON entity_id = related_id"""
)
def open_graph_placeholder(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    links = graph.relations(log, _ns(spark, d))
    parts = graph.partials(snapshot.latest(log), _catalog(spark, d))
    return graph.hydrate(graph.hop(_subjects(links), links), graph.merged_entities(parts))


@query(
    f"""WITH {_LINKS}, e AS (SELECT DISTINCT subject, predicate, object FROM rels)
SELECT DISTINCT a.subject AS start_id, c.object AS related_id FROM e a JOIN e b ON b.subject = a.object AND b.predicate = 'ns5:custodian' JOIN e c ON c.subject = b.object AND c.predicate = 'ns4:worksfor' WHERE a.predicate = 'ns6:device'"""
)
def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    """Work orders to the companies of the custodians of their devices."""
    links = _links(spark, d)
    return graph.multi_hop(_subjects(links), links, [("ns6:device", False), ("ns5:custodian", False), ("ns4:worksfor", False)])


@query(
    f"""WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT subject, object FROM rels WHERE predicate = 'ns6:follows'),
r AS (SELECT subject, object FROM e UNION SELECT r.subject, e.object FROM r JOIN e ON e.subject = r.object) SELECT subject, object FROM r"""
)
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_links(spark, d), "ns6:follows")


_ORDERED = f"""WITH {_LINKS}, h AS (SELECT subject AS start_id, predicate, object AS related_id, max(recorded) AS recorded FROM rels GROUP BY 1, 2, 3)
SELECT start_id, predicate, related_id, recorded FROM h ORDER BY start_id, recorded DESC, predicate DESC, related_id DESC LIMIT {PAGE}"""


@query(_ORDERED)
def paged_hop_page1(spark: SparkSession, d: str) -> DataFrame:
    return graph.page_hop(star_hop(spark, d), PAGE)


@query(_ORDERED + f" OFFSET {PAGE}")
def paged_hop_page2(spark: SparkSession, d: str) -> DataFrame:
    hops = star_hop(spark, d)
    last = graph.page_hop(hops, PAGE).collect()[-1]
    return graph.page_hop(hops, PAGE, (last.start_id, last.recorded, last.predicate, last.related_id))


_VISIBLE = f"{_VERS}, seen AS (SELECT * FROM vers WHERE dataset NOT IN (SELECT dataset FROM dataset_catalog WHERE deleted)), {_newest('latest_seen', 'seen')}, {_rels('rels', 'latest_seen')}"


@query(
    f"""WITH {_VISIBLE}, hub AS (SELECT object AS o, count(DISTINCT (subject, predicate)) AS n FROM rels GROUP BY 1 ORDER BY n DESC, o LIMIT 1)
SELECT object AS start_id, predicate, subject AS related_id, max(recorded) AS recorded FROM rels JOIN hub ON object = o GROUP BY 1, 2, 3"""
)
def hop_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages of the traversal backwards from the entity that most name, from token to token."""
    log, catalog, names = _log(spark, d), _catalog(spark, d), _ns(spark, d)
    links = graph.relations(snapshot.in_scope(log, catalog), names)
    hub = links.groupBy("object").agg(F.countDistinct("subject", "predicate").alias("n")).orderBy(F.col("n").desc(), "object").first()
    pages: list[DataFrame] = []
    paged_query(log, catalog, names, Query(starts=[hub.object], inverse=True), max(PAGE, hub.n // 8), lambda page: not pages.append(materialise(page.select("start_id", "predicate", "related_id", "recorded"), "page")))
    return reduce(DataFrame.unionByName, pages)


@query(
    f"""WITH {_LATEST}, p AS (
  SELECT entity_id, dataset_id, 'prop' AS kind, unnest(json_keys(props)) AS name, props AS j FROM latest JOIN dataset_catalog USING (dataset) WHERE NOT latest.deleted
  UNION ALL
  SELECT entity_id, dataset_id, 'ref', unnest(json_keys(refs)), refs FROM latest JOIN dataset_catalog USING (dataset) WHERE NOT latest.deleted),
v AS (SELECT entity_id, dataset_id, kind, name, json_extract(j, '$."' || name || '"') AS x FROM p),
g AS (SELECT entity_id, kind, name, count(*) AS n, min({_TEXT.format(x='x')}) AS one, string_agg(regexp_replace({_TEXT.format(x='x')}, '^\\[(.*)\\]$', '\\1'), ',' ORDER BY dataset_id) FILTER (WHERE CAST(x AS VARCHAR) <> '[]') AS many FROM v WHERE json_type(x) <> 'NULL' GROUP BY 1, 2, 3)
SELECT entity_id, kind, name, CASE WHEN n = 1 THEN one ELSE '[' || coalesce(many, '') || ']' END AS value FROM g"""
)
def merge_partials(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_values(graph.partials(snapshot.latest(_log(spark, d)), _catalog(spark, d)))


@query(f"WITH {_LATEST}, {_LIVE} SELECT entity_id, deleted, recorded, n_partials FROM ents")
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_entities(graph.partials(snapshot.latest(_log(spark, d)), _catalog(spark, d))).select("entity_id", "deleted", "recorded", "n_partials")


@query(
    f"""WITH {_LATEST}, a AS (SELECT entity_id, bool_or(NOT deleted) AS any_live FROM latest GROUP BY 1)
SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY dataset_id) - 1 AS INTEGER) AS position, dataset, l.deleted, recorded FROM latest l JOIN a USING (entity_id) JOIN (SELECT dataset, dataset_id FROM dataset_catalog) USING (dataset) WHERE NOT l.deleted OR NOT any_live"""
)
def multi_origin(spark: SparkSession, d: str) -> DataFrame:
    return graph.multi_origin(graph.partials(snapshot.latest(_log(spark, d)), _catalog(spark, d))).select("entity_id", "position", "dataset", "deleted", "recorded")


@query(f"WITH {_LATEST}, {_LIVE}, w AS (SELECT unnest(['ns5:gateway-1', 'ns5:nobody']) AS entity_id) SELECT entity_id, deleted, recorded, n_partials FROM w LEFT JOIN ents USING (entity_id)")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids, names = ["ns5:gateway-1", "ns5:nobody"], _ns(spark, d)
    raw = load(spark, d, "change_log").where(F.col("id").isin(names.spellings(ids)))  # reaches the scan
    return graph.lookup(change_table(raw, names, distinct=False), _catalog(spark, d), ids).select("entity_id", "deleted", "recorded", "n_partials")


@query(f"WITH {_VERS} SELECT entity_id, dataset, arg_max(seq, (recorded, batch_seq, seq)) AS latest_seq, max(recorded) AS latest_recorded, count(*) AS n_changes FROM vers GROUP BY 1, 2")
def entity_details(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_details(_log(spark, d, distinct=True))


# Writes


def _committed(spark: SparkSession, d: str) -> DataFrame:
    """The log before SINCE; what is compared with it are newest versions and ends, which repeated rows do not change."""
    return _log(spark, d).where(F.col("seq") < SINCE)


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d, distinct=True).where(F.col("seq") >= SINCE).withColumn("pos", F.col("seq"))


_WRITTEN = f"""{_VERS}, keyed AS (SELECT *, {_KEY} AS k FROM vers),
committed AS (SELECT dataset, entity_id, arg_max(k, (recorded, batch_seq, seq)) AS old FROM keyed WHERE seq < {SINCE} GROUP BY 1, 2),
batch AS (SELECT dataset, entity_id, seq AS pos, k, lag(k) OVER (PARTITION BY dataset, entity_id ORDER BY seq) AS prev FROM keyed WHERE seq >= {SINCE}),
kept AS (SELECT dataset, entity_id, pos FROM batch LEFT JOIN committed USING (dataset, entity_id) WHERE {{rule}})"""


@query(f"WITH {_WRITTEN.replace('{rule}', 'old IS NULL OR k <> old OR (prev IS NOT NULL AND k <> prev)')} SELECT dataset, entity_id, pos FROM kept")
def write_noop_suppression(spark: SparkSession, d: str) -> DataFrame:
    """The rows from offset SINCE on written onto the log before it."""
    return mutation.new_versions(_committed(spark, d), _incoming(spark, d)).select("dataset", "entity_id", "pos")


@query(f"WITH {_WRITTEN.replace('{rule}', 'CASE WHEN prev IS NULL THEN old IS NULL OR k <> old ELSE k <> prev END')} SELECT dataset, entity_id, pos FROM kept")
def write_strict(spark: SparkSession, d: str) -> DataFrame:
    return mutation.new_versions(_committed(spark, d), _incoming(spark, d), strict=True).select("dataset", "entity_id", "pos")


@query(
    f"""WITH {_WRITTEN.replace('{rule}', 'old IS NULL OR k <> old OR (prev IS NOT NULL AND k <> prev)')}, ends AS (SELECT dataset, max(seq) + 1 AS n FROM vers WHERE seq < {SINCE} GROUP BY 1)
SELECT kept.dataset, coalesce(n, 0) + row_number() OVER (PARTITION BY kept.dataset ORDER BY pos, entity_id) - 1 AS seq, entity_id, {AT} AS recorded FROM kept LEFT JOIN ends USING (dataset)"""
)
def transaction_apply(spark: SparkSession, d: str) -> DataFrame:
    return mutation.append(_committed(spark, d), _incoming(spark, d), AT).select("dataset", "seq", "entity_id", "recorded")


@query(f"WITH {_LATEST} SELECT dataset, entity_id FROM latest WHERE NOT deleted AND (dataset, entity_id) NOT IN (SELECT (dataset, entity_id) FROM vers WHERE recorded > {AT})")
def fullsync_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Entities that full syncs of what was recorded after AT would delete, of every dataset."""
    log = _log(spark, d)
    return mutation.unseen(log, log.where(F.col("recorded") > AT)).select("dataset", "entity_id")


@query(
    f"""WITH {_WRITTEN.replace('{rule}', 'old IS NULL OR k <> old OR (prev IS NOT NULL AND k <> prev)')}, ends AS (SELECT dataset, count(*) AS n FROM vers WHERE seq < {SINCE} GROUP BY 1)
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY seq) - 1 AS seq, entity_id FROM vers WHERE seq < {SINCE}
UNION ALL
SELECT kept.dataset, coalesce(n, 0) + row_number() OVER (PARTITION BY kept.dataset ORDER BY pos, entity_id) - 1, entity_id FROM kept LEFT JOIN ends USING (dataset)"""
)
def store_transactions(spark: SparkSession, d: str) -> DataFrame:
    """The log written to a store in two transactions, cut at SINCE, and read back."""
    log = materialise(_log(spark, d, distinct=True).withColumn("pos", F.col("seq")), "log")
    store = EntityStore(spark, keep_path(spark, "store"))
    for r in log.select("dataset").distinct().collect():
        store.create_dataset(r.dataset)
    for part in (log.where(F.col("seq") < SINCE), log.where(F.col("seq") >= SINCE)):
        store.transaction(part.select("dataset", "entity_id", "deleted", "props", "refs", "pos"))
    return store.changes().select("dataset", "seq", "entity_id")


# Sources and incremental processing


@query(f"WITH {_LATEST} SELECT dataset, entity_id, seq FROM latest WHERE dataset LIKE '%.person' OR dataset LIKE '%.company'")
def union_source(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    names = sorted(r.dataset for r in load(spark, d, "change_log").where("dataset LIKE '%.person' OR dataset LIKE '%.company'").select("dataset").distinct().collect())
    rows, _ = UnionDatasetSource(lambda: log, names).read_all()
    return rows.select("dataset", "entity_id", "seq")


@query("SELECT 'e-' || i AS entity_id FROM range(1000) t(i)")
def sample_source(spark: SparkSession, d: str) -> DataFrame:
    return SampleSource(spark, 1000).read_all()[0].select("entity_id")


@query(f"WITH {_VERS} SELECT CASE WHEN seq < {SINCE} THEN 1 ELSE 2 END AS run_no, dataset, count(*) AS n FROM vers GROUP BY 1, 2")
def incremental_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """What each of two runs over all datasets delivers: one when the log ended before SINCE, one from its token when the log is whole."""
    log = materialise(_log(spark, d, distinct=True).select("dataset", "seq").repartitionByRange("dataset", "seq").sortWithinPartitions("dataset", "seq"), "log")  # every dataset is read by itself
    names = sorted(r.dataset for r in log.select("dataset").distinct().collect())
    return two_runs(log.where(F.col("seq") < SINCE), log, names)


class _Kept:
    """A sink that keeps the place of every row it is given, by run."""

    def __init__(self) -> None:
        self.run_no, self.parts = 0, []

    def write(self, rows: DataFrame) -> int:
        self.parts.append(materialise(rows.select(F.lit(self.run_no).alias("run_no"), "dataset", "seq"), "kept"))
        return 0

    write_all = write


def two_runs(before: DataFrame, now: DataFrame, names: list[str]) -> DataFrame:
    """``(run_no, dataset, n)``: the rows that two runs of a job wrote, the first over ``before``, the second, from its stored token, over ``now``."""
    spark, logs, sink = now.sparkSession, [before], _Kept()
    job = Pipeline("two-runs", UnionDatasetSource(lambda: logs[-1], names), sink, JobState(keep_path(spark, "jobs")), batch=None)
    for log in (before, now):
        logs.append(log)
        sink.run_no += 1
        record = job.run()
        if not record["ok"]:
            raise RuntimeError(record["error"])
    rows = reduce(DataFrame.unionByName, sink.parts)
    return rows.groupBy("run_no", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dataset, max(seq) + 1 AS next_offset FROM change_log GROUP BY dataset")
def fullsync_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """The tokens that a full run over all datasets stores before it reads anything."""
    log = load(spark, d, "change_log")
    names = [r.dataset for r in log.select("dataset").distinct().collect()]
    return spark.createDataFrame(list(incremental.next_tokens(log, names).items()), "dataset string, next_offset bigint")


@query(
    """SELECT * FROM (VALUES ('x.company', 1, 'x.person', 'ns4:worksfor', true), ('x.town', 1, 'x.company', 'ns8:in', true), ('x.town', 2, 'x.person', 'ns4:worksfor', true), ('x.workorder', 1, 'x.person', 'ns6:assignee', false))
AS t(dataset, step, into_dataset, predicate, inverse)"""
)
def tracked_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """The dependencies that two query chains of a transform give, turned round."""
    tracker = incremental.Tracker("x.person")
    tracker.hop("x.company", "ns4:worksfor").hop("x.town", "ns8:in")
    tracker.ihop("x.workorder", "ns6:assignee")
    rows = [(dep.dataset, n, j.dataset, j.predicate, j.inverse) for dep in tracker.dependencies() for n, j in enumerate(dep.joins, 1)]
    return spark.createDataFrame(rows, "dataset string, step int, into_dataset string, predicate string, inverse boolean")


_SITES = "site AS (SELECT DISTINCT regexp_replace(dataset, '\\.person$', '') AS s FROM change_log WHERE dataset LIKE '%.person')"
_CHANGED = f"""{_SITES},
ch AS (SELECT DISTINCT s, entity_id FROM vers JOIN site ON dataset = s || '.company' WHERE seq >= {SINCE}),
main AS (SELECT s, latest.* FROM latest JOIN site ON dataset = s || '.person'),
reached AS (SELECT DISTINCT main.* FROM main JOIN rels ON subject = main.entity_id AND predicate = 'ns4:worksfor' JOIN ch ON ch.s = main.s AND ch.entity_id = object)"""


def _companies(site: str) -> incremental.Dependency:
    return incremental.Dependency(site + ".company", (incremental.Join(site + ".person", "ns4:worksfor", True),))


def _of_all_sites(spark: SparkSession, d: str, dependency) -> DataFrame:
    """``(site, entity_id)``: the persons of every site that changes of its dependency reach, as one job per site finds them."""
    log, names, sites = _log(spark, d), _ns(spark, d), _sites(spark, d)
    links = materialise(incremental.chain_links(log, names, [dependency(s) for s in sites]), "chain-links")
    found = [incremental.touched_by(log, names, s + ".person", dependency(s), SINCE, links=links).select(F.lit(s).alias("site"), "entity_id") for s in sites]
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {_LINKS}, {_CHANGED} SELECT DISTINCT s AS site, entity_id FROM reached")
def multisource_dependency(spark: SparkSession, d: str) -> DataFrame:
    """Persons to process because their company changed."""
    return _of_all_sites(spark, d, _companies)


_BEFORE = f"""before AS (SELECT s, max(recorded) AS t FROM vers JOIN site ON dataset = s || '.workorder' WHERE seq < {SINCE} GROUP BY s),
prior AS (SELECT vers.* REPLACE (s || '|' || vers.dataset AS dataset) FROM vers JOIN ch USING (entity_id) JOIN before USING (s) WHERE vers.recorded <= t), {_newest('latest_prior', 'prior')}, {_rels('rels_prior', 'latest_prior')}"""


@query(
    f"""WITH {_LINKS}, {_SITES}, ch AS (SELECT DISTINCT s, entity_id FROM vers JOIN site ON dataset = s || '.workorder' WHERE seq >= {SINCE}), {_BEFORE},
both_times AS (
  SELECT ch.s, object FROM rels JOIN ch ON entity_id = subject WHERE predicate = 'ns6:assignee'
  UNION
  SELECT split_part(dataset, '|', 1), object FROM rels_prior WHERE predicate = 'ns6:assignee'
)
SELECT DISTINCT s AS site, entity_id FROM latest JOIN both_times ON object = entity_id AND dataset = s || '.person'"""
)
def multisource_removed_link(spark: SparkSession, d: str) -> DataFrame:
    """Persons to process because a work order that names them, or named them before, changed."""
    return _of_all_sites(spark, d, lambda site: incremental.Dependency(site + ".workorder", (incremental.Join(site + ".person", "ns6:assignee"),)))


@query(
    f"""WITH {_LINKS}, {_CHANGED}, own AS (SELECT vers.dataset, vers.seq FROM vers JOIN site ON dataset = s || '.person' WHERE seq >= {SINCE})
SELECT dataset, seq FROM own UNION SELECT dataset, seq FROM reached"""
)
def multisource_changes(spark: SparkSession, d: str) -> DataFrame:
    log, names = materialise(_log(spark, d, distinct=True), "log"), _ns(spark, d)  # one job per site reads it
    each = [incremental.multi_source(log, names, s + ".person", [_companies(s)], {s + ".person": SINCE, s + ".company": SINCE}) for s in _sites(spark, d)]
    return reduce(DataFrame.unionByName, each).select("dataset", "seq")


# Maintenance


@query(f"WITH {_VERS}, keyed AS (SELECT dataset, entity_id, seq, {_KEY} AS k, recorded, batch_seq FROM vers), l AS (SELECT *, lag(k) OVER (PARTITION BY dataset, entity_id ORDER BY recorded, batch_seq, seq) AS p FROM keyed) SELECT dataset, seq FROM l WHERE p IS NULL OR k <> p")
def compaction_dedup(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.compact(_log(spark, d, distinct=True)).select("dataset", "seq")


@query(f"WITH {_VERS} SELECT dataset, seq FROM vers WHERE dataset NOT IN (SELECT dataset FROM dataset_catalog WHERE deleted)")
def garbage_collection(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.collect_garbage(_log(spark, d, distinct=True), _catalog(spark, d)).select("dataset", "seq")


@query(f"WITH {_VERS} SELECT dataset, count(DISTINCT entity_id) AS items FROM vers GROUP BY 1")
def items_count(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.item_counts(_log(spark, d))


@query(f"WITH {_VERS} SELECT dataset, deleted, count(*) AS versions, CAST(sum(strlen(dataset) + strlen(entity_id)) AS BIGINT) AS key_bytes, CAST(sum(strlen(props) + strlen(refs)) AS BIGINT) AS value_bytes FROM vers GROUP BY ROLLUP (dataset, deleted)")
def dataset_statistics(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.statistics(_log(spark, d, distinct=True))


def _job_configs(spark: SparkSession, d: str) -> DataFrame:
    """The lineage relations as the job configurations they came from."""
    r = load(spark, d, "lineage_rel")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    hop = F.col("rel_type").endswith("-hop")
    return r.select(F.when(hop, none).otherwise(one("from_name")).alias("sources"), one("to_name").alias("sinks"), F.col("rel_type").startswith("transform").alias("transforms"), F.when(hop, one("from_name")).otherwise(none).alias("hops"), none.alias("transactions"))


@query("SELECT DISTINCT from_name, to_name, rel_type FROM lineage_rel WHERE from_name IS NOT NULL AND to_name IS NOT NULL")
def lineage_all(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.lineage(_job_configs(spark, d))


@query("WITH n AS (SELECT min(from_name) AS x FROM lineage_rel) SELECT DISTINCT from_name, to_name, rel_type FROM lineage_rel, n WHERE from_name IS NOT NULL AND to_name IS NOT NULL AND (from_name = x OR to_name = x)")
def lineage_dataset(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.lineage(_job_configs(spark, d), load(spark, d, "lineage_rel").agg(F.min("from_name")).first()[0])


_RULES = [access.Rule("/datasets/core.*", "write"), access.Rule("/datasets/a*"), access.Rule("/datasets/o*", "read", deny=True)]


@query("SELECT dataset, dataset_id FROM dataset_catalog WHERE starts_with(dataset, 'core.') OR starts_with(dataset, 'a')")
def acl_filter(spark: SparkSession, d: str) -> DataFrame:
    return access.visible_datasets(_catalog(spark, d), _RULES).select("dataset", "dataset_id")


@query("SELECT dataset, dataset_id, kind FROM dataset_catalog WHERE NOT coalesce(deleted, false)")
def dataset_list(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).where("NOT deleted").orderBy("dataset").select("dataset", "dataset_id", "kind")


# Formats


_QUOTED = "CAST(to_json({x}) AS VARCHAR)"


@query(
    f"""WITH {_LATEST}, {_VALUES}, props_of AS (SELECT dataset, entity_id, string_agg({_QUOTED.format(x='name')} || ':' || value, ',' ORDER BY {_QUOTED.format(x='name')} || ':' || value) AS p FROM v GROUP BY 1, 2),
rk AS (SELECT dataset, entity_id, unnest(json_keys(refs)) AS name, refs FROM latest WHERE NOT deleted), rv AS (SELECT dataset, entity_id, name, json_extract(refs, '$."' || name || '"') AS x FROM rk),
r1 AS (SELECT dataset, entity_id, {_QUOTED.format(x='name')} || ':' || CASE WHEN json_type(x) = 'ARRAY' THEN '[' || array_to_string(list_transform(CAST(x AS VARCHAR[]), lambda t: '{{"@id":' || {_QUOTED.format(x='t')} || '}}'), ',') || ']' ELSE '{{"@id":' || CAST(x AS VARCHAR) || '}}' END AS t FROM rv WHERE json_type(x) <> 'NULL'),
refs_of AS (SELECT dataset, entity_id, string_agg(t, ',' ORDER BY t) AS r FROM r1 GROUP BY 1, 2)
SELECT entity_id, '{{' || concat_ws(',', '"@id":' || {_QUOTED.format(x='entity_id')}, p, r) || '}}' AS json FROM latest LEFT JOIN props_of USING (dataset, entity_id) LEFT JOIN refs_of USING (dataset, entity_id) WHERE NOT latest.deleted"""
)
def jsonld_rows(spark: SparkSession, d: str) -> DataFrame:
    return formats.jsonld(snapshot.latest(_log(spark, d), include_deleted=False))


@query(f"""WITH {_LATEST} SELECT entity_id, '{{"id":' || {_QUOTED.format(x='entity_id')} || ',"recorded":' || recorded || ',"deleted":' || deleted || ',"refs":' || refs || ',"props":' || props || '}}' AS json FROM latest""")
def entity_json_rows(spark: SparkSession, d: str) -> DataFrame:
    return formats.entity_json(snapshot.latest(_log(spark, d)))


@query(f"WITH {_LATEST} SELECT entity_id, recorded, deleted FROM latest")
def stream_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Newest versions written as entity streams, a batch each, and parsed again.

    The format has no null references; a stored one holds nothing and is left out.
    """
    table = [(r.prefix, r.expansion) for r in load(spark, d, "namespace_map").orderBy("ord").limit(1_000).collect()]
    context = uri.PrefixTable(table).context()
    prefixes = {e: p for p, e in table[::-1]}

    def parse(batches):
        for batch in batches:
            document = "".join(formats.stream_text(context, iter(batch.column("json").to_pylist()), "end"))
            rows = formats.compact_rows(formats.parse_stream(document)[0], prefixes)
            yield pa.RecordBatch.from_pylist([{"entity_id": i, "recorded": rec, "deleted": gone} for i, rec, gone, _, _ in rows], schema=pa.schema([("entity_id", pa.string()), ("recorded", pa.int64()), ("deleted", pa.bool_())]))

    rows = entity.stored(entity.typed(snapshot.latest(_log(spark, d))))
    return formats.entity_json(rows).select("json").mapInArrow(parse, "entity_id string, recorded bigint, deleted boolean")


# Star-schema tables


@query("SELECT 'customer:' || o_custkey AS start_id, 'customer' AS predicate, 'orders:' || o_orderkey AS related_id FROM orders")
def customer_orders(spark: SparkSession, d: str) -> DataFrame:
    links = stars.table_links(load(spark, d, "orders"), "orders")
    starts = load(spark, d, "customer").select(stars.entity_id("customer", F.col("c_custkey")).alias("start_id"))
    return graph.hop(starts, links, "customer", inverse=True).select("start_id", "predicate", "related_id")


@query("SELECT 'region:' || r_regionkey AS start_id, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def region_orders(spark: SparkSession, d: str) -> DataFrame:
    links = None
    for t in ("nation", "customer", "orders"):
        part = stars.table_links(load(spark, d, t), t)
        links = part if links is None else links.unionByName(part)
    starts = load(spark, d, "region").select(stars.entity_id("region", F.col("r_regionkey")).alias("start_id"))
    reached = graph.multi_hop(starts, links, [("region", True), ("nation", True), ("customer", True)])
    return reached.groupBy("start_id").agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT 'user:' || user_id AS entity_id, event_id AS seq, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def events_latest(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.latest(stars.event_changes(load(spark, d, "events")), payload=()).select("entity_id", "seq", "deleted")


@query("SELECT 'user:' || user_id AS subject, 'customer:' || user_id AS object FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def events_links(spark: SparkSession, d: str) -> DataFrame:
    log = stars.event_changes(load(spark, d, "events"))
    live = snapshot.latest(log, include_deleted=False, payload=("refs",))
    return live.select(F.col("entity_id").alias("subject"), F.explode(ref_pairs(F.col("refs"))).alias("r")).select("subject", F.col("r.target").alias("object"))
