"""Queries of the general training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..identity import Namespaces
from ..operators import current_state, hierarchy, increments, nested, orphans, snapshot_diff, widen
from ..session import keep_path, materialise
from ..tables import load


def _namespaces(spark: SparkSession, d: str) -> Namespaces:
    return Namespaces(load(spark, d, "namespace_map"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.parent_links(load(spark, d, "lineage_rel")))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.hierarchy(hierarchy.parent_links(load(spark, d, "lineage_rel")), with_path=True)
    return found.select("node_name", "root_name", "node_depth", F.array_join("path", " > ").alias("full_path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All datasets below each dataset, those on and below loops marked with the loop's name."""
    return hierarchy.below(hierarchy.parent_links(load(spark, d, "lineage_rel")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = nested.shared_inlining(load(spark, d, "raw_payloads"))
    return nested.node_links(rows)


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """The cells of every table row, with the row's key and foreign key."""
    rows, _ = nested.shared_inlining(load(spark, d, "raw_payloads"))
    key = ("record_id", "delivery", "table_name", "row_path", "parent_table", "parent_path", "entity_id", "recorded", "deleted")
    return rows.select(*key, F.explode_outer("cells").alias("c")).select(
        *key, F.col("c.key").alias("column_name"), F.col("c.value").alias("cell")
    )


def p2_refs(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with its target and the row that holds its owner."""
    return nested.references(nested.shared_inlining(load(spark, d, "raw_payloads"))[0])


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Id, recorded and deleted of every body and nested entity, also of those inlined in another's row."""
    return nested.entities(nested.shared_inlining(load(spark, d, "raw_payloads"))[0])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    index = snapshot_diff.OrdinalIndex(spark, keep_path(spark, "ordinal-index"))
    return snapshot_diff.snapshot_changes(load(spark, d, "dataset_snapshots"), _namespaces(spark, d), index)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(load(spark, d, "change_log"), _namespaces(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return increments.open_rows(load(spark, d, "sync_job_state"), load(spark, d, "change_log"))


def p5_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The whole log consumed by one job that fails after its sink took some rows, replays its plan and then commits."""
    log = load(spark, d, "change_log")
    folder = keep_path(spark, "replay")
    names = [r.dataset for r in log.where("dataset IS NOT NULL").select("dataset").distinct().collect()]
    planned = increments.IncrementalRun(folder, "j", names).begin(log)
    held = materialise(planned.where("seq < 200"), "sink")  # what the sink had taken when the run failed
    again = increments.IncrementalRun(folder, "j", names)
    rest = materialise(increments.sink_once(again.delivered(held), again.begin(log)), "sink")
    again.commit()
    none = increments.IncrementalRun(folder, "j", names).begin(log)  # nothing is left
    return held.unionByName(rest).unionByName(none).select("dataset", "seq")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "change_log").select("dataset", "id", "recorded", "batch_seq", "deleted")
    feed = _namespaces(spark, d).compress(log, "id")
    *batches, base = current_state.time_batches(feed, "recorded", 4)
    return current_state.newest_first(batches, base)


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    return widen.widen(load(spark, d, "entity_attrs"), load(spark, d, "attr_types"), _namespaces(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.long_cells(p7_wide(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_tables, p2_refs, p2_entities, p3_found, p4_found, p4_report, p5_found, p5_replayed, p6_found, p7_found, p7_wide)}

# A CURIE for a URI whose part before the last '#' or '/' is a known expansion.
_CURIE = """coalesce((SELECT n.prefix FROM namespace_map n WHERE n.expansion = left({c}, length({c}) - length(regexp_extract({c}, '[^{sep}]*$'))))
 || ':' || regexp_extract({c}, '[^{sep}]*$'), {c})"""


def curie_sql(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%#%' THEN {_CURIE.format(c=c, sep='#')} WHEN {c} LIKE '%/%' THEN {_CURIE.format(c=c, sep='/')} ELSE {c} END"


def _canonical_sql(column: str, condition: str = "") -> str:
    """A JSON text as one line per value: place, type and value, numbers by value."""
    return f"""(SELECT string_agg(fullkey || ' ' || CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'n' || CAST(atom AS VARCHAR)
  WHEN type = 'DOUBLE' THEN 'n' || regexp_replace(CAST(CAST(atom AS DOUBLE) AS VARCHAR), '\\.0$', '')
  WHEN type = 'VARCHAR' THEN 's' || (atom ->> '$') WHEN type = 'BOOLEAN' THEN 'b' || CAST(atom AS VARCHAR) ELSE type END, chr(10) ORDER BY fullkey)
  FROM json_tree(CAST(coalesce({column}, '{{}}') AS JSON)) {condition})"""


_LINKS = "links AS (SELECT to_name AS node, min(from_name) AS parent FROM lineage_rel WHERE from_name IS NOT NULL AND to_name IS NOT NULL AND rel_type IN ('copy','transform') GROUP BY to_name)"

_WALK = f"""WITH RECURSIVE {_LINKS},
up AS (
  SELECT node, parent AS top, 1 AS depth, [node] AS trail, parent = node AS looped FROM links
  UNION ALL
  SELECT u.node, l.parent, u.depth + 1, list_append(u.trail, l.node), list_contains(list_append(u.trail, l.node), l.parent)
  FROM up u JOIN links l ON l.node = u.top WHERE NOT u.looped
),
ends AS (
  SELECT node, top, depth, trail, looped FROM up u WHERE looped OR NOT EXISTS (SELECT 1 FROM links l WHERE l.node = u.top)
)"""

ORACLE = {
    "p1_found": f"""{_WALK}
SELECT node AS node_name,
       CASE WHEN looped THEN list_min(trail[list_position(trail, top):]) ELSE top END AS root_name,
       CASE WHEN looped THEN -1 ELSE depth END AS node_depth
FROM ends""",
    "p1_paths": f"""{_WALK}
SELECT node AS node_name,
       CASE WHEN looped THEN list_min(trail[list_position(trail, top):]) ELSE top END AS root_name,
       CASE WHEN looped THEN -1 ELSE depth END AS node_depth,
       CASE WHEN NOT looped THEN array_to_string(list_reverse(list_append(trail, top)), ' > ') END AS full_path
FROM ends""",
    "p1_descendants": f"""{_WALK}
SELECT u.top AS node_name, u.node AS descendant, min(u.depth) AS distance, any_value(CASE WHEN e.looped THEN list_min(e.trail[list_position(e.trail, e.top):]) END) AS loop_name
FROM up u JOIN ends e ON e.node = u.node WHERE u.top <> u.node GROUP BY u.top, u.node""",
    "p2_found": """WITH RECURSIVE node AS (
  SELECT DISTINCT record_id, '' AS path, '' AS owner, CAST(body AS JSON) AS v, true AS is_body FROM raw_payloads WHERE body IS NOT NULL AND json_valid(body) AND json_type(body) = 'OBJECT'
  UNION ALL
  SELECT n.record_id, n.path || '/' || e.key, CASE WHEN json_type(n.v) = 'ARRAY' THEN n.owner ELSE n.path END, e.value, false
  FROM node n, json_each(CASE WHEN json_type(n.v) = 'OBJECT' AND (n.is_body OR list_contains(json_keys(n.v), 'props') OR list_contains(json_keys(n.v), 'refs')) THEN n.v -> '$.props' ELSE n.v END) e
  WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
),
entity AS (SELECT record_id, path, v -> '$.refs' AS r FROM node WHERE json_type(v) = 'OBJECT' AND (is_body OR list_contains(json_keys(v), 'props') OR list_contains(json_keys(v), 'refs'))),
ref AS (
  SELECT e.record_id, e.path AS owner, e.path || '/@refs/' || p.key AS path, p.value AS v FROM entity e, json_each(e.r) p WHERE json_type(e.r) = 'OBJECT'
),
one AS (
  SELECT record_id, owner, path, v FROM ref WHERE json_type(v) <> 'ARRAY'
  UNION ALL
  SELECT ref.record_id, ref.owner, ref.path || '/' || i.key, i.value FROM ref, json_each(ref.v) i WHERE json_type(ref.v) = 'ARRAY'
)
SELECT DISTINCT record_id, 'object' AS node_kind, path AS node_path, owner AS parent_path FROM node WHERE json_type(v) = 'OBJECT' AND path <> ''
UNION
SELECT record_id, 'ref', path, owner FROM one WHERE json_type(v) = 'VARCHAR'""",
    "p3_found": f"""WITH s AS (
  SELECT dataset, snapshot_no, {curie_sql('id')} AS id, delivered_at, {_canonical_sql('props', "WHERE NOT (type = 'NULL' AND path = '$')")} AS p, {_canonical_sql('refs')} AS r
  FROM (SELECT DISTINCT * FROM dataset_snapshots)
),
one AS (SELECT dataset, snapshot_no, id, arg_max(p || chr(0) || r, delivered_at) AS c FROM s GROUP BY 1, 2, 3),
nos AS (SELECT dataset, snapshot_no, lag(snapshot_no) OVER (PARTITION BY dataset ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT dataset, snapshot_no FROM one)),
new AS (SELECT one.*, before FROM one JOIN nos USING (dataset, snapshot_no) WHERE before IS NOT NULL),
old AS (SELECT one.dataset, one.id, one.c, nos.snapshot_no AS at FROM one JOIN nos ON nos.dataset = one.dataset AND nos.before = one.snapshot_no)
SELECT coalesce(new.dataset, old.dataset) AS dataset, coalesce(new.snapshot_no, old.at) AS snapshot_no, coalesce(new.id, old.id) AS id,
       CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new FULL JOIN old ON old.dataset = new.dataset AND old.at = new.snapshot_no AND old.id = new.id
WHERE old.id IS NULL OR new.id IS NULL OR old.c <> new.c""",
    "p7_found": f"""WITH a AS (SELECT dataset, {curie_sql('id')} AS id, {curie_sql('attr')} AS attr, val, recorded FROM entity_attrs),
n AS (SELECT dataset, id, attr, val FROM a QUALIFY row_number() OVER (PARTITION BY dataset, id, attr ORDER BY recorded DESC, val DESC) = 1),
l AS (
  SELECT dataset, id, attr, dtype, val LIKE '"%' AS quoted, CASE WHEN val LIKE '"%' THEN json_extract_string(val, '$') ELSE val END AS txt
  FROM n JOIN attr_types USING (attr) WHERE val <> 'null' AND val NOT LIKE '[%' AND val NOT LIKE '{{%'
),
t AS (SELECT *, trim(txt, ' ') AS x, regexp_full_match(trim(txt, ' '), '-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][-+]?[0-9]+)?') AS num FROM l),
c AS (
  SELECT dataset, id, attr, CASE dtype
    WHEN 'string' THEN txt
    WHEN 'boolean' THEN CASE WHEN lower(x) IN ('true', 'false') THEN lower(x) END
    WHEN 'date' THEN CASE WHEN quoted AND regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T.*)?') AND try_cast(x[:10] AS DATE) IS NOT NULL THEN x[:10] END
    WHEN 'double' THEN CASE WHEN num THEN CAST(CAST(round(try_cast(x AS DECIMAL(38, 6)) * 1000) AS HUGEINT) AS VARCHAR) END
    WHEN 'bigint' THEN CASE WHEN num AND try_cast(x AS DECIMAL(38, 6)) = trunc(try_cast(x AS DECIMAL(38, 6))) THEN CAST(try_cast(CAST(try_cast(x AS DECIMAL(38, 6)) AS HUGEINT) AS BIGINT) AS VARCHAR) END
  END AS cell FROM t
)
SELECT dataset, id, attr, cell FROM c WHERE cell IS NOT NULL""",
    "p4_found": f"""WITH vers AS (
  SELECT DISTINCT dataset, seq, {curie_sql('id')} AS id, recorded, batch_seq, coalesce(deleted, false) AS deleted, refs FROM change_log
),
named AS (
  SELECT dataset, seq, recorded, unnest(json_keys(refs)) AS predicate, refs FROM vers WHERE NOT deleted AND refs IS NOT NULL
),
vals AS (
  SELECT dataset, seq, recorded, predicate, json_extract(refs, '$."' || predicate || '"') AS v FROM named
),
targets AS (
  SELECT dataset, seq, recorded, predicate, v ->> '$' AS target FROM vals WHERE json_type(v) = 'VARCHAR'
  UNION
  SELECT dataset, seq, recorded, predicate, e ->> '$' FROM (SELECT dataset, seq, recorded, predicate, unnest(CAST(v AS JSON[])) AS e FROM vals WHERE json_type(v) = 'ARRAY') WHERE json_type(e) = 'VARCHAR'
),
wanted AS (SELECT DISTINCT dataset, seq, recorded, {curie_sql('predicate')} AS predicate, {curie_sql('target')} AS target_id FROM targets),
newest AS (
  SELECT w.seq, w.dataset, w.predicate, w.target_id, v.dataset AS holder, arg_max(v.deleted, (v.recorded, v.batch_seq)) AS gone
  FROM wanted w JOIN vers v ON v.id = w.target_id AND v.recorded <= w.recorded GROUP BY ALL
),
state AS (SELECT dataset, seq, predicate, target_id, bool_and(gone) AS gone FROM newest GROUP BY ALL),
judged AS (
  SELECT w.dataset, w.seq, w.predicate, w.target_id, w.recorded,
         CASE WHEN s.gone THEN 'deleted' WHEN s.gone IS NOT NULL THEN NULL
              WHEN w.target_id IN (SELECT id FROM vers) THEN 'late' ELSE 'missing' END AS reason
  FROM wanted w LEFT JOIN state s USING (dataset, seq, predicate, target_id)
)
SELECT dataset, strftime(make_timestamp(recorded // 1000), '%Y-%m') AS period_ym, seq, predicate, target_id, reason FROM judged WHERE reason IS NOT NULL""",
    "p5_found": r"""WITH jobs AS (SELECT job_id, arg_max(source_names, run_no) AS names FROM sync_job_state GROUP BY job_id),
good AS (SELECT job_id, arg_max(coalesce(token, ''), run_no) AS token FROM sync_job_state WHERE lastrunok GROUP BY job_id),
src AS (
  SELECT job_id, token, unnest(CAST(names AS VARCHAR[])) AS dataset, generate_subscripts(CAST(names AS VARCHAR[]), 1) AS pos
  FROM jobs LEFT JOIN good USING (job_id)
),
raw AS (
  SELECT DISTINCT job_id, dataset,
    CASE WHEN token LIKE '{%"Tokens"%' THEN (json_extract_string(token, '$.Tokens[*].Token'))[list_position(CAST(json_extract(token, '$.DatasetNames') AS VARCHAR[]), dataset)]
         WHEN token LIKE '{%' AND pos = 1 THEN json_extract_string(token, '$.MainToken')
         WHEN token LIKE '{%' THEN json_extract_string(token, '$.DependencyTokens."' || dataset || '".Token')
         ELSE token END AS t
  FROM src
),
offs AS (
  SELECT job_id, dataset, coalesce(CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT)
         WHEN t <> '' THEN try_cast(decode(from_base64(t)) AS BIGINT) END, 0) AS first_open
  FROM raw
)
SELECT DISTINCT o.job_id, l.dataset, l.seq FROM offs o JOIN change_log l ON l.dataset = o.dataset AND l.seq >= o.first_open""",
    "p5_replayed": "SELECT DISTINCT dataset, seq FROM change_log WHERE dataset IS NOT NULL AND seq IS NOT NULL",
    "p6_found": f"""WITH vers AS (SELECT dataset, {curie_sql('id')} AS id, recorded, batch_seq, coalesce(deleted, false) AS deleted FROM change_log),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY recorded DESC, batch_seq DESC, deleted) AS n FROM vers)
SELECT dataset, id, recorded, batch_seq FROM ranked WHERE n = 1 AND NOT deleted""",
}
# The parsed bodies as nodes with the objects that enclose them, the elements that have tables, and each object's table row.
_PROPS_OF = "CASE WHEN json_type(n.v) = 'OBJECT' AND (n.is_body OR list_contains(json_keys(n.v), 'props') OR list_contains(json_keys(n.v), 'refs')) THEN n.v -> '$.props' ELSE n.v END"
_PLACED = f"""WITH RECURSIVE node AS (
  SELECT record_id, left(md5(body), 16) AS delivery, '' AS path, CAST(NULL AS VARCHAR) AS owner, CAST(body AS JSON) AS v, true AS is_body, '' AS element, CAST(NULL AS VARCHAR) AS parent_element, false AS repeated,
    [{{'e': '', 'p': ''}}] AS chain, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS up_path, false AS up_array
  FROM (SELECT DISTINCT record_id, body FROM raw_payloads WHERE record_id IS NOT NULL AND body IS NOT NULL) WHERE json_valid(body) AND json_type(body) = 'OBJECT'
  UNION ALL
  SELECT n.record_id, n.delivery, n.path || '/' || e.key, CASE WHEN json_type(n.v) = 'ARRAY' THEN n.owner ELSE n.path END, e.value, false,
    CASE WHEN json_type(n.v) = 'ARRAY' THEN n.element ELSE e.key END, CASE WHEN json_type(n.v) = 'ARRAY' THEN n.parent_element ELSE n.element END, json_type(n.v) = 'ARRAY',
    CASE WHEN json_type(e.value) = 'OBJECT' THEN list_append(n.chain, {{'e': CASE WHEN json_type(n.v) = 'ARRAY' THEN n.element ELSE e.key END, 'p': n.path || '/' || e.key}}) ELSE n.chain END,
    CASE WHEN json_type(n.v) = 'ARRAY' THEN n.name || '/' || e.key ELSE e.key END, n.path, json_type(n.v) = 'ARRAY'
  FROM node n, json_each({_PROPS_OF}) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
),
obj AS (SELECT *, is_body OR list_contains(json_keys(v), 'props') OR list_contains(json_keys(v), 'refs') AS is_entity FROM node WHERE json_type(v) = 'OBJECT'),
own AS (SELECT coalesce(list(element), []) AS names FROM (SELECT element FROM obj WHERE NOT is_body GROUP BY element HAVING bool_or(repeated) OR count(DISTINCT parent_element) > 1 OR bool_or(element = parent_element))),
lined AS (SELECT obj.*, list_filter(chain, lambda x: x.p = '' OR list_contains(names, x.e)) AS line FROM obj, own),
placed AS (
  SELECT record_id, delivery, line[-1].e AS table_name, line[-1].p AS row_path, line[-2].e AS parent_table, line[-2].p AS parent_path, path, v, is_entity, path = line[-1].p AS here,
    CASE WHEN is_entity AND json_type(v, '$.id') = 'VARCHAR' THEN v ->> '$.id' END AS entity_id,
    CASE WHEN is_entity AND json_type(v, '$.recorded') <> 'NULL' THEN v ->> '$.recorded' END AS recorded, CASE WHEN is_entity AND json_type(v, '$.deleted') <> 'NULL' THEN v ->> '$.deleted' END AS deleted
  FROM lined
)"""
ORACLE["p2_entities"] = f"""{_PLACED}
SELECT record_id, delivery, table_name, row_path, path AS node_path, entity_id, recorded, deleted FROM placed WHERE coalesce(entity_id, recorded, deleted) IS NOT NULL"""
ORACLE["p2_refs"] = f"""{_PLACED}, ref AS (SELECT p.* EXCLUDE v, e.key AS predicate, '/@refs/' || e.key AS tail, e.value AS x FROM (SELECT * FROM placed WHERE is_entity AND json_type(v, '$.refs') = 'OBJECT') p, json_each(p.v -> '$.refs') e),
one AS (SELECT * FROM ref WHERE json_type(x) <> 'ARRAY' UNION ALL SELECT ref.* EXCLUDE (tail, x), tail || '/' || i.key, i.value FROM ref, json_each(x) i WHERE json_type(x) = 'ARRAY')
SELECT record_id, delivery, table_name, row_path, path AS owner_path, predicate, path || tail AS ref_path, x ->> '$' AS target FROM one WHERE json_type(x) = 'VARCHAR'"""
ORACLE["p2_tables"] = f"""{_PLACED}, mixed AS (SELECT DISTINCT a.record_id, a.delivery, a.path FROM node a JOIN obj o ON o.record_id = a.record_id AND o.delivery = a.delivery AND o.owner = a.owner AND starts_with(o.path, a.path || '/') WHERE json_type(a.v) = 'ARRAY'),
plain AS (
  SELECT n.* FROM node n LEFT JOIN mixed up ON up.record_id = n.record_id AND up.delivery = n.delivery AND up.path = n.up_path LEFT JOIN mixed m ON m.record_id = n.record_id AND m.delivery = n.delivery AND m.path = n.path
  WHERE NOT n.is_body AND json_type(n.v) <> 'OBJECT' AND m.path IS NULL AND (NOT n.up_array OR up.path IS NOT NULL)
),
cells AS (
  SELECT p.record_id, p.delivery, p.row_path, CASE WHEN here THEN '' ELSE substr(p.path, length(p.row_path) + 2) || '/' END || plain.name AS column_name,
    CASE json_type(plain.v) WHEN 'VARCHAR' THEN plain.v ->> '$' WHEN 'NULL' THEN NULL ELSE regexp_replace(regexp_replace(CAST(plain.v AS VARCHAR), '(\\.[0-9]*[1-9])0+([,}}\\]]|$)', '\\1\\2', 'g'), '\\.0+([,}}\\]]|$)', '\\1', 'g') END AS cell
  FROM plain JOIN placed p ON p.record_id = plain.record_id AND p.delivery = plain.delivery AND p.path = plain.owner
)
SELECT record_id, delivery, table_name, row_path, parent_table, parent_path, entity_id, recorded, deleted, column_name, cell FROM (SELECT * FROM placed WHERE here) LEFT JOIN cells USING (record_id, delivery, row_path)"""
# The attributes and types of attr_types, which the wide table has as columns.
_WIDE = {
    "bigint": ["ns3:age", "ns7:grade", "ns5:ports", "ns5:cycles", "ns4:staff"],
    "double": ["ns3:height", "ns5:mass", "ns5:offset", "ns4:rating"],
    "boolean": ["ns3:active", "ns5:wired", "ns4:listed"],
    "date": ["ns3:hired", "ns7:leave", "ns5:installed", "ns5:checked", "ns4:founded"],
    "string": ["ns3:fullname", "ns3:badge", "ns5:label", "ns5:serial", "ns4:title", "ns4:unit"],
}
_COLUMNS = ", ".join(
    f"CAST(max(cell) FILTER (WHERE attr = '{a}') AS " + ("BIGINT) / 1000.0" if t == "double" else f"{t.upper()})".replace("STRING", "VARCHAR")) + f' AS "{a}"' for t, names in _WIDE.items() for a in names
)
ORACLE["p7_wide"] = f"""WITH ids AS (SELECT DISTINCT dataset, {curie_sql('id')} AS id FROM entity_attrs WHERE dataset IS NOT NULL AND id IS NOT NULL)
SELECT dataset, id, {_COLUMNS} FROM ids LEFT JOIN ({ORACLE['p7_found']}) USING (dataset, id) GROUP BY dataset, id"""
ORACLE["p4_report"] = f"SELECT dataset, period_ym, reason, count(*) AS n_refs, count(DISTINCT target_id) AS n_targets FROM ({ORACLE['p4_found']}) GROUP BY ALL"
