"""The declarative query: lookups and paged traversals with continuations."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..identity import Namespaces
from ..operators import graph, snapshot
from ..session import materialise

DEFAULT_LIMIT = 100


@dataclass
class Query:
    """What to look up (``entity_id``) or where to walk from (``starts``, or the tokens of an earlier page).

    ``at`` is kept in the tokens, so all pages are of one moment.
    """

    entity_id: str | None = None
    starts: list[str] = field(default_factory=list)
    predicate: str = graph.ANY
    inverse: bool = False
    datasets: list[str] = field(default_factory=list)
    limit: int | None = None
    at: int | None = None
    merge: bool = True
    details: bool = False
    continuation: str | None = None

    @classmethod
    def parse(cls, body: dict) -> "Query":
        """From the request form; a predicate is required for traversals."""
        starts = list(body.get("startingEntities") or [])
        tokens = body.get("continuations") or []
        if starts and not body.get("predicate"):
            raise ValueError("a traversal needs a predicate")
        if not (body.get("entityId") or starts or tokens):
            raise ValueError("nothing to query")
        return cls(body.get("entityId"), starts, body.get("predicate") or graph.ANY, bool(body.get("inverse")), list(body.get("datasets") or []), body.get("limit"), None, not body.get("noPartialMerging"), bool(body.get("details")), tokens[0] if tokens else None)


@dataclass
class Result:
    rows: DataFrame
    continuation: str | None = None


def run_query(log: DataFrame, catalog: DataFrame, namespaces: Namespaces | None, query: Query, kept: dict | None = None) -> Result:
    """Runs a query. Traversal rows are (start_id, predicate, related_id, recorded) with the related
    entity's columns; only an explicit limit gives a continuation, without one 100 rows come.

    ``kept`` holds the hops of a traversal between its pages, so the log is reduced to
    them once; give the same dictionary to every page of one traversal.
    """
    visible = snapshot.in_scope(log, catalog)
    scope = [r.dataset for r in catalog.select("dataset").where(catalog.dataset.isin(query.datasets)).distinct().collect()] if query.datasets else []
    if query.entity_id is not None:
        if query.details:
            return Result(graph.entity_details(visible, [query.entity_id]))
        if not query.merge:
            rows = snapshot.in_scope(visible, catalog, scope).where(visible.entity_id == query.entity_id)
            return Result(graph.with_partials(graph.partials(snapshot.latest(rows, query.at), catalog)))
        return Result(graph.lookup(visible, catalog, [query.entity_id], scope or None, query.at))
    after = None
    if query.continuation:
        held = json.loads(snapshot.decode_token(query.continuation))
        query = Query(starts=held["starts"], predicate=held["predicate"], inverse=held["inverse"], datasets=held["datasets"], limit=query.limit or held["limit"], at=held["at"], merge=held["merge"])
        scope, after = held["datasets"], tuple(held["after"])
    at = query.at
    if at is None:
        at = visible.agg({"recorded": "max"}).first()[0] or 0
    key = json.dumps([query.starts, query.predicate, query.inverse, scope, at])
    hops = None if kept is None else kept.get(key)
    if hops is None:
        links = graph.relations(visible, namespaces, at)
        starts = log.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(query.starts)], "start_id string")
        hops = graph.hop(starts, links, query.predicate, query.inverse, scope or None)
        if kept is not None:
            hops = kept[key] = materialise(hops, "hops")
    limit = query.limit or DEFAULT_LIMIT
    page = graph.page_hop(hops, limit, after)
    token = None
    if query.limit:
        seen = page.collect()  # one page
        page = log.sparkSession.createDataFrame(seen, page.schema)
        if len(seen) == limit:
            last = seen[-1]
            token = snapshot.encode_token({"starts": query.starts, "predicate": query.predicate, "inverse": query.inverse, "datasets": scope, "limit": limit, "at": at, "merge": query.merge, "after": [last.start_id, last.recorded, last.predicate, last.related_id]})
    wanted = page.select(page.related_id.alias("entity_id")).distinct()
    versions = snapshot.in_scope(visible, catalog, scope).join(wanted, "entity_id", "left_semi")  # only the page's entities are reduced and merged
    related = graph.partials(snapshot.latest(versions), catalog)
    entities = graph.merged_entities(related) if query.merge else graph.with_partials(related)
    return Result(page.join(entities.drop("recorded").withColumnRenamed("entity_id", "related_id"), "related_id", "left"), token)


def paged_query(log: DataFrame, catalog: DataFrame, namespaces: Namespaces | None, query: Query, page_size: int, call: Callable[[DataFrame], bool]) -> str | None:
    """Calls ``call`` with page after page until it returns false; the token to go on from, None at the end."""
    query.limit = page_size
    kept: dict = {}
    while True:
        result = run_query(log, catalog, namespaces, query, kept)
        if not call(result.rows) or result.continuation is None:
            return result.continuation
        query = Query(continuation=result.continuation, limit=page_size)
