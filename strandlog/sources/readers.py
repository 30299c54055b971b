"""Sources of jobs: what to read next and the token to store afterwards."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..identity import Namespaces
from ..operators import incremental, snapshot
from ..operators.incremental import Dependency, Tracker, dependencies_from_config
from ..session import keep_path
from .durations import seconds
from .http import TokenProvider, get_page

if TYPE_CHECKING:
    from ..store import EntityStore

Log = Callable[[], DataFrame]
ENTITY_ROWS = "entity_id string, recorded bigint, deleted boolean, props string, refs string"


class Source(Protocol):
    """``read`` gives rows in order of ``seq`` and the next token; a full read ignores the token."""

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]: ...

    def read_all(self) -> tuple[DataFrame, str]: ...


class DatasetSource:
    """A dataset's change feed, or, in full, its newest versions."""

    def __init__(self, log: Log, name: str, latest_only: bool = False):
        self.log, self.name, self.latest_only = log, name, latest_only

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        since = int(token or 0)
        page = snapshot.feed(self.log(), self.name, since, limit, self.latest_only)
        return page, str(snapshot.next_offset(page, since))

    def read_all(self) -> tuple[DataFrame, str]:
        log = self.log().where(F.col("dataset") == self.name)
        following = str(incremental.next_tokens(log, [self.name])[self.name])
        return snapshot.latest(log), following


class UnionDatasetSource:
    """Several datasets after one another, each with its own token."""

    def __init__(self, log: Log, names: list[str], latest_only: bool = False):
        self.names, self.parts = names, [DatasetSource(log, n, latest_only) for n in names]

    def _tokens(self, token: str) -> list[str]:
        if not token:
            return [""] * len(self.names)
        held = json.loads(token)
        if held["DatasetNames"] != self.names:
            raise ValueError("the datasets of the union or their order changed")
        return [t["Token"] for t in held["Tokens"]]

    def _token(self, tokens: Iterable[str]) -> str:
        return json.dumps({"Tokens": [{"Token": t} for t in tokens], "DatasetNames": self.names})

    def _union(self, pages: list[tuple[DataFrame, str]]) -> tuple[DataFrame, str]:
        out = pages[0][0]
        for page, _ in pages[1:]:
            out = out.unionByName(page, allowMissingColumns=True)
        return out, self._token(t for _, t in pages)

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        if limit is None and len(set(self.names)) == len(self.names):
            return self._read_whole(token)
        return self._union([p.read(t, limit) for p, t in zip(self.parts, self._tokens(token))])

    def _read_whole(self, token: str) -> tuple[DataFrame, str]:
        """All open rows of all datasets in one pass, in order of the datasets and their offsets."""
        since = {n: int(t or 0) for n, t in zip(self.names, self._tokens(token))}
        log = self.parts[0].log().where(F.col("dataset").isin(self.names))
        log = snapshot.latest_only(log) if self.parts[0].latest_only else log
        begins = log.sparkSession.createDataFrame([(n, at, s) for at, (n, s) in enumerate(since.items())], "dataset string, __at int, __since bigint")
        rows = log.join(F.broadcast(begins), "dataset").where(F.col("seq") >= F.col("__since"))  # a row per dataset of the job
        following = snapshot.next_offsets(rows, since)
        return rows.orderBy("__at", "seq").select(*log.columns), self._token(str(following[n]) for n in self.names)

    def read_all(self) -> tuple[DataFrame, str]:
        return self._union([p.read_all() for p in self.parts])


class MultiSource:
    """A main dataset and those its entities are joined with; a change in either is a change of the main entity."""

    def __init__(self, log: Log, name: str, dependencies: list[Dependency], namespaces: Namespaces | None = None, latest_only: bool = False):
        self.log, self.name, self.dependencies, self.namespaces, self.latest_only = log, name, dependencies, namespaces, latest_only

    def _parse(self, token: str) -> dict[str, int]:
        held = json.loads(token)
        return {self.name: int(held["MainToken"] or 0), **{d: int(t["Token"] or 0) for d, t in (held.get("DependencyTokens") or {}).items() if d != self.name}}

    def _format(self, tokens: dict[str, int]) -> str:
        others = {d: {"Token": str(t)} for d, t in tokens.items() if d != self.name}
        return json.dumps({"MainToken": str(tokens[self.name]), "DependencyTokens": others})

    def _now(self, log: DataFrame) -> dict[str, int]:
        return incremental.next_tokens(log, list(dict.fromkeys([self.name, *(d.dataset for d in self.dependencies)])))

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        if not token:  # without a token only a full read is right
            return self.read_all()
        log = self.log()
        now = self._now(log)
        return incremental.multi_source(log, self.namespaces, self.name, self.dependencies, self._parse(token), self.latest_only), self._format(now)

    def read_all(self) -> tuple[DataFrame, str]:
        log = self.log()
        now = self._now(log)  # before the scan, so changes during it come again
        return snapshot.latest(log.where(F.col("dataset") == self.name)), self._format(now)


class HttpDatasetSource:
    """A remote dataset; the token is the remote's own. Also reads proxy datasets."""

    def __init__(self, spark: SparkSession, url: str, token_provider: TokenProvider | None = None, page: int | None = None, latest_only: bool = False):
        self.spark, self.url, self.provider, self.page, self.latest_only = spark, url, token_provider, page, latest_only

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        rows, following = get_page(self.url, token or None, limit or self.page, self.latest_only, token=self.provider)
        return self.spark.createDataFrame(rows, ENTITY_ROWS), following or token

    def read_all(self) -> tuple[DataFrame, str]:
        """All pages, one after another, into a table on shared storage: the driver holds one page at a time."""
        path, last, pos, token = keep_path(self.spark, "remote"), "", 0, None
        while True:
            rows, following = get_page(self.url, token, self.page, self.latest_only, token=self.provider)
            self.spark.createDataFrame([(*r, pos + n) for n, r in enumerate(rows)], ENTITY_ROWS + ", pos bigint").coalesce(1).write.mode("append").parquet(path)
            pos, last = pos + len(rows), following or last
            if not rows or following is None or following == token:
                return self.spark.read.schema(ENTITY_ROWS + ", pos bigint").parquet(path), last
            token = following


class VirtualSource:
    """Rows made by a function ``build(params, since, limit) -> (DataFrame, token)``."""

    def __init__(self, build: Callable[[dict, str, int | None], tuple[DataFrame, str]], params: dict | None = None):
        self.build, self.params = build, params or {}

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        return self.build(self.params, token, limit)

    def read_all(self) -> tuple[DataFrame, str]:
        return self.build(self.params, "", None)


class SampleSource:
    """``n`` made-up entities ``e-0 ...``; the token is the number already given."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        a = int(token or 0)
        b = self.n if limit is None else min(self.n, a + limit)
        rows = self.spark.range(a, max(a, b)).select(F.concat(F.lit("e-"), F.col("id").cast("string")).alias("entity_id"), F.lit(False).alias("deleted"), F.lit("{}").alias("props"), F.lit("{}").alias("refs"))
        return rows, str(max(a, b))

    def read_all(self) -> tuple[DataFrame, str]:
        return self.read("", None)


class SlowSource:
    """``n`` entities after a pause, the same at every read; there is nothing to go on from."""

    def __init__(self, spark: SparkSession, n: int, pause: float):
        self.sample, self.pause = SampleSource(spark, n), pause

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        time.sleep(self.pause)
        return self.sample.read("")[0], ""

    def read_all(self) -> tuple[DataFrame, str]:
        return self.read("")


class RequeueSource:
    """Rows a job failed on before, then its main source."""

    def __init__(self, failed: Log, main: Source):
        self.failed, self.main = failed, main

    def read(self, token: str, limit: int | None = None) -> tuple[DataFrame, str]:
        rows, following = self.main.read(token, limit)
        return self.failed().unionByName(rows, allowMissingColumns=True), following

    def read_all(self) -> tuple[DataFrame, str]:
        return self.main.read_all()


#: The keys that each type of source takes.
_KEYS = {
    "DatasetSource": {"Name", "LatestOnly"},
    "UnionDatasetSource": {"DatasetSources", "LatestOnly"},
    "MultiSource": {"Name", "Dependencies", "LatestOnly"},
    "HttpDatasetSource": {"Url", "TokenProvider"},
    "SampleSource": {"NumberOfEntities"},
    "SlowSource": {"BatchSize", "Sleep"},
    "VirtualSource": {"Name", "Params"},
}


def flag(value: object) -> bool:
    """A flag given as such or as text."""
    if isinstance(value, str):
        if value.lower() not in ("true", "false", "1", "0", "t", "f"):
            raise ValueError(f"no flag: {value!r}")
        return value.lower() in ("true", "1", "t")
    return bool(value)


def checked(config: dict, keys: dict[str, set[str]], what: str) -> str:
    """The type of a part of a job configuration; unknown types and keys are errors, so none is ignored."""
    kind = config.get("Type")
    if kind not in keys:
        raise ValueError(f"unknown {what} type {kind}")
    if unknown := set(config) - keys[kind] - {"Type"}:
        raise ValueError(f"{kind} does not know {sorted(unknown)}")
    return kind


def named(table: dict | None, name: str | None, what: str) -> Callable | None:
    """The registered function of a name (case does not matter); None for no name, an error for an unknown one."""
    if not name:
        return None
    found = {k.lower(): f for k, f in (table or {}).items()}.get(name.lower())
    if found is None:
        raise ValueError(f"no {what} {name} is registered")
    return found


def make_source(
    config: dict,
    spark: SparkSession,
    log: Log,
    namespaces: Namespaces | Callable[[], Namespaces] | None = None,
    registry: dict[str, Callable] | None = None,
    store: "EntityStore | None" = None,
    tokens: dict[str, TokenProvider] | None = None,
    track: Callable[[Tracker], None] | None = None,
) -> Source:
    """A source from its job configuration; unknown or incomplete ones are errors.

    With a ``store`` a proxy dataset becomes the remote it stands for and a virtual one
    the function that builds it. ``track`` registers the queries of the job's transform
    as dependencies of a multi source.
    """
    kind = checked(config, _KEYS, "source")
    latest = flag(config.get("LatestOnly", False))
    held = lambda name: (store.dataset(name) if store is not None else None) or {"kind": "regular"}
    if kind == "DatasetSource":
        d = held(config["Name"])
        if d["kind"] == "proxy":
            return HttpDatasetSource(spark, d["url"].rstrip("/") + "/changes", named(tokens, d.get("token_provider"), "token provider"), latest_only=latest)
        if d["kind"] == "virtual":
            return VirtualSource(named(registry, d["build"], "function"), d.get("params"))
        return DatasetSource(log, config["Name"], latest)
    if kind == "UnionDatasetSource":
        names = [c["Name"] for c in config["DatasetSources"]]
        if odd := [n for n in names if held(n)["kind"] != "regular"]:
            raise ValueError(f"{odd} cannot be part of a union")
        return UnionDatasetSource(log, names, latest or any(flag(c.get("LatestOnly", False)) for c in config["DatasetSources"]))
    if kind == "MultiSource":
        proxies = frozenset(n for n in (store.dataset_names() if store is not None else ()) if held(n)["kind"] == "proxy")
        found = dependencies_from_config(config.get("Dependencies") or [], config["Name"], proxies)
        if track is not None:
            tracker = Tracker(config["Name"], proxies)
            track(tracker)
            found += [d for d in tracker.dependencies() if d not in found]
        return MultiSource(log, config["Name"], found, namespaces, latest)
    if kind == "HttpDatasetSource":
        return HttpDatasetSource(spark, config["Url"], named(tokens, config.get("TokenProvider"), "token provider"))
    if kind == "SampleSource":
        return SampleSource(spark, int(config.get("NumberOfEntities") or 0))
    if kind == "SlowSource":
        return SlowSource(spark, int(config.get("BatchSize") or 0), seconds(config.get("Sleep", 0)))
    return VirtualSource(named(registry, config["Name"], "function"), config.get("Params"))
