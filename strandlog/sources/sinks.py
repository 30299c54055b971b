"""Sinks of jobs."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame

from .http import TokenProvider, post_entities, post_full_sync
from .readers import checked, flag, named

if TYPE_CHECKING:
    from ..store import EntityStore

_log = logging.getLogger(__name__)


class Sink(Protocol):
    def write(self, entities: DataFrame) -> int: ...

    def write_all(self, entities: DataFrame) -> int: ...


class DatasetSink:
    """Appends real changes to a dataset; a full write also deletes what was not delivered."""

    def __init__(self, store: "EntityStore", name: str, changed: Callable[[str], object] | None = None):
        self.store, self.name, self.changed = store, name, changed

    def _announce(self, n: int) -> int:
        if n and self.changed is not None:
            self.changed(f"dataset.{self.name}")
        return n

    def write(self, entities: DataFrame) -> int:
        return self._announce(self.store.store_entities(self.name, entities))

    def write_all(self, entities: DataFrame) -> int:
        return self._announce(self.store.full_sync(self.name, entities))


class HttpDatasetSink:
    """Posts entities to a remote dataset; also writes proxy datasets."""

    def __init__(self, url: str, context: dict | Callable[[], dict], batch: int = 1000, token: TokenProvider | None = None):
        self.url, self.batch, self.token = url, batch, token
        self.context = context if callable(context) else lambda: context  # a function gives the namespaces as they are at the write

    def write(self, entities: DataFrame) -> int:
        post_entities(entities, self.url, self.context(), batch=self.batch, token=self.token)
        return -1

    def write_all(self, entities: DataFrame) -> int:
        post_full_sync(entities, self.url, self.context(), uuid.uuid4().hex, self.batch, token=self.token)
        return -1


class DevNullSink:
    """Reads everything and keeps nothing."""

    def write(self, entities: DataFrame) -> int:
        entities.write.format("noop").mode("overwrite").save()
        return 0

    write_all = write


class ConsoleSink:
    """Logs the number of rows, or, in detail, the rows of the batch."""

    def __init__(self, prefix: str = "", detailed: bool = False, out: Callable[[str], None] = _log.info):
        self.prefix, self.detailed, self.out = prefix, detailed, out

    def write(self, entities: DataFrame) -> int:
        if not self.detailed:
            n = entities.count()
            self.out(f"{self.prefix}{n} entities")
            return n
        n = 0
        for n, row in enumerate(entities.toLocalIterator(), 1):  # one partition at a time
            self.out(f"{self.prefix}{row.asDict()}")
        return n

    write_all = write


#: The keys that each type of sink takes.
_KEYS = {"DatasetSink": {"Name"}, "HttpDatasetSink": {"Url", "TokenProvider"}, "DevNullSink": set(), "ConsoleSink": {"Prefix", "Detailed"}}


def make_sink(config: dict, store: "EntityStore | None" = None, context: dict | Callable[[], dict] | None = None, tokens: dict[str, TokenProvider] | None = None, changed: Callable[[str], object] | None = None) -> Sink:
    """A sink from its job configuration; a proxy dataset becomes the remote it stands for.

    ``changed`` is called with ``dataset.<name>`` after a write that changed a local dataset.
    """
    kind = checked(config, _KEYS, "sink")
    context = context or {"id": "@context", "namespaces": {}}
    if kind == "DatasetSink":
        held = (store.dataset(config["Name"]) if store is not None else None) or {"kind": "regular"}
        if held["kind"] == "virtual":
            raise ValueError("a virtual dataset cannot be written")
        if held["kind"] == "proxy":
            return HttpDatasetSink(held["url"].rstrip("/") + "/entities", context, token=named(tokens, held.get("token_provider"), "token provider"))
        return DatasetSink(store, config["Name"], changed)
    if kind == "HttpDatasetSink":
        return HttpDatasetSink(config["Url"], context, token=named(tokens, config.get("TokenProvider"), "token provider"))
    if kind == "DevNullSink":
        return DevNullSink()
    return ConsoleSink(config.get("Prefix", ""), flag(config.get("Detailed", False)))
