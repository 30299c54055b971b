"""One object with everything a user of the entity store can ask for."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.access import Rule, visible_datasets
from .identity import Namespaces
from .operators import graph, maintenance, snapshot
from .plans.pipeline import ErrorPolicy, EventBus, JobManager, JobState, Pipeline, error_policies
from .plans.query import Query, Result, run_query
from .sources import formats
from .sources.http import http_transform
from .sources.readers import checked, flag, make_source, named
from .sources.sinks import make_sink
from .store import EntityStore

#: The keys that each type of transform takes.
_TRANSFORM_KEYS = {"HttpTransform": {"Url", "TokenProvider", "TimeOut", "SupportContext"}, "FunctionTransform": {"Name", "Parallelism"}}

_INCOMING = "entity_id string, recorded bigint, deleted boolean, props string, refs string"


class Hub:
    """Datasets, queries, jobs and maintenance over one folder of shared storage.

    Documents are entity streams or transactions as text; entities come back as frames,
    or as documents by :meth:`document`. ``functions`` are user code that configurations
    name: transforms (frame to frame; an attribute ``track_queries`` registers what they
    look up), builders of virtual datasets and queries. ``tokens`` are token providers by
    name. Jobs added by configuration alone are kept and are there again after a restart;
    those that cannot be built then are in ``broken``. ``core_namespace`` is what ``core``
    expands to in JSON-LD.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: list[Rule] | None = None, functions: dict[str, Callable] | None = None, tokens: dict[str, Callable[[], str]] | None = None, core_namespace: str = formats.CORE):
        self.spark, self.rules, self.functions, self.tokens, self.core_namespace = spark, rules, functions or {}, tokens or {}, core_namespace
        self.store = EntityStore(spark, os.path.join(folder, "store"))
        self.jobs = JobManager(JobState(os.path.join(folder, "jobs")))
        self.bus = EventBus()
        self.jobs.attach(self.bus)
        self._seen: dict[str, DataFrame] = {}
        self.broken: dict[str, str] = {}
        for config in self.jobs.stored():
            try:
                self.add_job(config)
            except ValueError as error:  # a function or token provider that is not registered any more
                self.broken[config["id"]] = str(error)

    # namespaces

    def namespaces(self) -> dict[str, str]:
        return self.store.context()["namespaces"]

    def _names(self) -> Namespaces:
        return Namespaces(self.spark.createDataFrame(self.store.prefixes().rows(), "prefix string, expansion string, ord int"))

    def _incoming(self, rows: list[tuple]) -> DataFrame:
        """Rows of a document in the store's spelling; new expansions get a prefix first."""
        table = self.store.prefixes()
        local: dict[str, str] = {}

        def name(uri: str) -> str:
            return table.canonical(uri, local) if uri.startswith(("http://", "https://")) else uri

        def value(v: object) -> object:
            if isinstance(v, list):
                return [value(x) for x in v]
            if isinstance(v, dict):
                return {k: ({name(n): value(x) for n, x in y.items()} if k == "props" else {name(n): target(x) for n, x in y.items()} if k == "refs" else name(y) if k == "id" else y) for k, y in v.items()}
            return v

        def target(v: str | list[str]) -> str | list[str]:
            return [name(x) for x in v] if isinstance(v, list) else name(v)

        out = [
            (name(i), rec, d, json.dumps({name(n): value(v) for n, v in json.loads(p).items()}), json.dumps({name(n): target(v) for n, v in json.loads(r).items()}))
            for i, rec, d, p, r in rows
        ]
        self.store.save_prefixes(table)
        return self.spark.createDataFrame([(n, *row) for n, row in enumerate(out)], "pos bigint, " + _INCOMING)

    # datasets

    def datasets(self) -> list[str]:
        """Names in order, only those that the rules show."""
        if self.rules is None:
            return self.store.dataset_names()
        return [r.dataset for r in visible_datasets(self.store.catalog(), self.rules).orderBy("dataset").collect()]

    def create_dataset(self, name: str, **options: object) -> int:
        return self.store.create_dataset(name, **options)

    def rename_dataset(self, name: str, new_name: str) -> None:
        self.store.rename_dataset(name, new_name)

    def delete_dataset(self, name: str) -> None:
        self.store.delete_dataset(name)

    def delete_all(self) -> None:
        for name in self.store.dataset_names():
            self.store.delete_dataset(name)

    def dataset_info(self, name: str) -> dict:
        return self.store.dataset_entities().where(F.col("dataset") == name).first().asDict()

    def entities(self, dataset: str, after: str | None = None, limit: int = 0) -> DataFrame:
        return snapshot.entity_page(self.store.entities(dataset), after, limit)

    def changes(self, dataset: str, since: str = "", limit: int | None = None, latest_only: bool = False, reverse: bool = False) -> tuple[DataFrame, str]:
        """(rows, token to go on from). Proxy datasets ask their remote, virtual ones their function."""
        if self.store.dataset(dataset)["kind"] != "regular":
            if reverse:
                raise ValueError(f"{dataset} cannot be read in reverse")
            source = make_source({"Type": "DatasetSource", "Name": dataset, "LatestOnly": latest_only}, self.spark, self.store.changes, registry=self.functions, store=self.store, tokens=self.tokens)
            return source.read(since, limit)
        start = int(snapshot.decode_token(since) or 0)
        page = self.store.feed(dataset, start, limit=limit, only_latest=latest_only, reverse=reverse)
        if reverse:
            lowest = page.agg(F.min("seq")).first()[0]
            return page, snapshot.encode_token(max(0, lowest - 1)) if lowest else ""
        return page, snapshot.encode_token(snapshot.next_offset(page, start))

    def document(self, dataset: str, rows: DataFrame, token: str | None = None, jsonld: bool = False) -> Iterator[str]:
        """Rows as the parts of an entity stream, or of a JSON-LD list; one partition is held at a time."""
        context = self.store.context(dataset)
        if jsonld:
            yield "[" + json.dumps(formats.jsonld_context(context, self.core_namespace))
            for r in formats.jsonld(rows).toLocalIterator():
                yield "," + r.json
            if token is not None:
                yield "," + json.dumps(formats.jsonld_continuation(token))
            yield "]"
            return
        yield from formats.stream_text(context, (r.json for r in formats.entity_json(rows).toLocalIterator()), token)

    def post_entities(self, dataset: str, document: str, sync_id: str | None = None, start: bool = False, end: bool = False) -> int:
        """Stores an entity stream; with ``sync_id`` as part of a full sync. Announces the change."""
        rows = self._incoming(formats.parse_stream(document)[0])
        if sync_id is not None:
            if start:
                self.store.start_full_sync(dataset, sync_id)
                self._seen.pop(dataset, None)
            else:
                self.store.refresh_full_sync(dataset, sync_id)
            held = self._seen.get(dataset)
            self._seen[dataset] = rows.select("entity_id") if held is None else held.unionByName(rows.select("entity_id"))
        n = self.store.store_entities(dataset, rows.drop("recorded"), sync_id=sync_id)
        if sync_id is not None and end:
            n += self.store.end_full_sync(dataset, sync_id, self._seen.pop(dataset))
        if sync_id is None or end:
            self.bus.emit(f"dataset.{dataset}")
        return n

    def post_transaction(self, document: str) -> int:
        """Stores a transaction document: all its datasets or none."""
        parts = formats.parse_transaction(document)
        rows = None
        for dataset, entities in parts.items():
            part = self._incoming(entities).drop("recorded").withColumn("dataset", F.lit(dataset))
            rows = part if rows is None else rows.unionByName(part)
        n = self.store.transaction(rows) if rows is not None else 0
        for dataset in parts:
            self.bus.emit(f"dataset.{dataset}")
        return n

    # queries

    def query(self, body: dict) -> Result:
        """Runs a query of the request form; a predicate whose prefix is no namespace of the store is an error."""
        prefix, colon, _ = (body.get("predicate") or "").partition(":")
        if colon and prefix not in self.store.context()["namespaces"]:
            raise ValueError(f"unknown predicate {body['predicate']}")
        return run_query(self.store.changes(), self.store.catalog(), None, Query.parse(body))

    def relations(self, at: int | None = None) -> DataFrame:
        return graph.relations(self.store.changes(), at=at)

    # jobs

    def add_job(self, config: dict, transforms: list | None = None) -> None:
        """Builds the job's source, transform, sink and error policies from its configuration and registers it.

        ``transforms`` are functions given as such, after the configured one; a job that
        has any is not kept over a restart, because functions cannot be stored.
        """
        self.jobs.verify(config)
        policies = error_policies(config["triggers"])
        steps, track = self._transform(config.get("transform"))
        source = make_source(config["source"], self.spark, self.store.changes, registry=self.functions, store=self.store, tokens=self.tokens, track=track)
        sink = make_sink(config["sink"], self.store, self.store.context, self.tokens, self.bus.emit)
        pipeline = Pipeline(config["id"], source, sink, self.jobs.state, [*steps, *(transforms or [])], batch=int(config.get("batchSize") or 10_000), errors=policies.get("incremental", ErrorPolicy()), full_errors=policies.get("fullsync", ErrorPolicy()))
        self.jobs.add(config, pipeline, keep=not transforms)
        self.broken.pop(config["id"], None)

    def _transform(self, config: dict | None) -> tuple[list, Callable | None]:
        """(steps, what registers the queries) of a configured transform.

        ``HttpTransform`` posts entities to ``Url``; ``FunctionTransform`` calls the
        registered function ``Name``, with ``Parallelism`` on rows spread over as many tasks.
        """
        if not config:
            return [], None
        if config.get("Type") == "JavascriptTransform":
            raise ValueError("JavaScript is not run here: register a Python function and name it in a FunctionTransform")
        if checked(config, _TRANSFORM_KEYS, "transform") == "HttpTransform":
            token = named(self.tokens, config.get("TokenProvider"), "token provider")

            def post(df: DataFrame) -> DataFrame:  # the namespaces as they are at the run
                return http_transform(config["Url"], float(config.get("TimeOut") or 0), context=self.store.context() if flag(config.get("SupportContext", False)) else None, token=token)(df)

            return [post], None
        function, n = named(self.functions, config["Name"], "function"), int(config.get("Parallelism") or 0)
        return [(lambda df: function(df.repartition(n))) if n > 1 else function], getattr(function, "track_queries", None)

    def user_query(self, name: str, **params: object) -> Iterator[str]:
        """The result of the registered query function, called with this object, as the parts of a JSON array.

        It gives a frame, whose rows become objects, or JSON values one by one; one
        partition of a frame is held at a time.
        """
        result = named(self.functions, name, "function")(self, **params)
        parts = (r.json for r in result.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator()) if isinstance(result, DataFrame) else (json.dumps(x) for x in result)
        yield "["
        for n, part in enumerate(parts):
            yield ("," if n else "") + part
        yield "]"

    # maintenance

    def lineage(self, dataset: str | None = None) -> DataFrame:
        rows = [maintenance.lineage_row(self.jobs.config(j)) for j in self.jobs.jobs()]
        return maintenance.lineage(self.spark.createDataFrame(rows, maintenance.LINEAGE_JOBS), dataset)

    def statistics(self, dataset: str | None = None) -> DataFrame:
        changes = self.store.changes()
        stats = maintenance.index_statistics(changes, graph.relations(changes))
        return stats if dataset is None else stats.where(F.col("dataset") == dataset)

    def compact(self) -> None:
        self.store.compact()

    def collect_garbage(self) -> None:
        self.store.collect_garbage()
