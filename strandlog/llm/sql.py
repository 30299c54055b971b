"""DuckDB oracles of the training-text queries; mixing and splitting have none in SQL."""

_FOUND = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM eval_items),
dw AS (SELECT doc_id, array_to_string(a[k:k + 11], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 10)) AS k FROM w WHERE len(a) >= 12)),
iw AS (SELECT item_id, array_to_string(a[k:k + 11], ' ') AS g FROM (SELECT item_id, a, unnest(range(1, len(a) - 10)) AS k FROM i WHERE len(a) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""

ORACLE = {
    "p8_found": _FOUND,
    "p8_items": f"SELECT item_id, suite, n_docs FROM (SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM ({_FOUND}) GROUP BY item_id) JOIN eval_items USING (item_id)",
}
