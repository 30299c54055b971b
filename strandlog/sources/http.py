"""Reading from and writing to remote entity endpoints over HTTP."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .formats import compact_rows, entity_json, parse_entities, parse_stream

TokenProvider = Callable[[], str]

#: Seconds a write may take, tries of a write, and seconds between them.
TIMEOUT, TRIES, PAUSE = 3600, 3, 2.0


def _request(url: str, data: bytes | None = None, headers: dict | None = None, token: TokenProvider | None = None, timeout: float | None = TIMEOUT) -> bytes:
    h = dict(headers or {})
    if token is not None:
        h["Authorization"] = f"Bearer {token()}"
    with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=h), timeout=timeout) as r:
        return r.read()


def _send(url: str, body: bytes, headers: dict, token: TokenProvider | None = None, tries: int = TRIES, pause: float = PAUSE) -> None:
    """A post that is tried again when it fails."""
    for n in range(tries):
        try:
            _request(url, body, {"Content-Type": "application/json", **headers}, token)
            return
        except (urllib.error.URLError, OSError):
            if n + 1 == tries:
                raise
            time.sleep(pause)


def with_query(url: str, **query: object) -> str:
    """``url`` with query parameters added; nulls are left out."""
    kept = {k: v for k, v in query.items() if v is not None}
    return url + ("&" if "?" in url else "?") + urllib.parse.urlencode(kept) if kept else url


def get_page(url: str, since: str | None = None, limit: int | None = None, latest_only: bool = False, reverse: bool = False, token: TokenProvider | None = None, start: str | None = None) -> tuple[list[tuple], str | None]:
    """(rows, continuation) of one page of a remote dataset: changes go on at ``since``, entities at ``start``."""
    full = with_query(url, **{"from": start or None}, since=since or None, limit=limit, latestOnly="true" if latest_only else None, reverse="true" if reverse else None)
    return parse_stream(_request(full, token=token).decode())


def post_entities(entities: DataFrame, url: str, context: dict, headers: dict | None = None, batch: int = 1000, tries: int = TRIES, pause: float = PAUSE, token: TokenProvider | None = None) -> None:
    """Every partition posts its entities in batches; a failed request is tried again.

    The receiver sees a batch more than once if a task is repeated; it must treat equal
    versions as no change. ``token`` is called where a request is made, so it must be
    something that can be sent to other machines.
    """
    head = json.dumps(context)

    def work(part: Iterator) -> None:
        held: list[str] = []

        def send() -> None:
            _send(url, ("[" + ",".join([head, *held]) + "]").encode(), headers or {}, token, tries, pause)
            held.clear()

        for row in part:
            held.append(row.json)
            if len(held) >= batch:
                send()
        if held:
            send()

    entity_json(entities).foreachPartition(work)


def full_sync_headers(sync_id: str, start: bool = False, end: bool = False) -> dict:
    """Headers that mark requests of a full sync; only the first starts and only the last ends it."""
    h = {"full-sync-id": sync_id}
    if start:
        h["full-sync-start"] = "true"
    if end:
        h["full-sync-end"] = "true"
    return h


def post_full_sync(entities: DataFrame, url: str, context: dict, sync_id: str, batch: int = 1000, tries: int = TRIES, pause: float = PAUSE, token: TokenProvider | None = None) -> None:
    """A whole dataset as one full sync: start, entities from all partitions, end; each request is tried again when it fails."""
    empty = json.dumps([context]).encode()
    _send(url, empty, full_sync_headers(sync_id, start=True), token, tries, pause)
    post_entities(entities, url, context, full_sync_headers(sync_id), batch, tries, pause, token)
    _send(url, empty, full_sync_headers(sync_id, end=True), token, tries, pause)


_ROWS = "entity_id string, recorded bigint, deleted boolean, props string, refs string"
_ARROW = pa.schema([("entity_id", pa.string()), ("recorded", pa.int64()), ("deleted", pa.bool_()), ("props", pa.string()), ("refs", pa.string())])


def http_transform(url: str, timeout: float | None = 60, batch: int = 1000, context: dict | None = None, token: TokenProvider | None = None) -> Callable[[DataFrame], DataFrame]:
    """A transform that posts batches of entities as a JSON array and takes the entities that come back.

    With a ``context`` it is the first element both ways, and names come back in its
    spelling; expansions that it does not have stay full URIs. A ``timeout`` of 0 or None
    sets no limit. Rows come back as ``(entity_id, recorded, deleted, props, refs)``.
    """
    head = [json.dumps(context)] if context is not None else []
    prefixes = {e: p for p, e in (context or {}).get("namespaces", {}).items()}

    def transform(df: DataFrame) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                texts = part.column("json").to_pylist()
                for at in range(0, len(texts), batch):
                    body = ("[" + ",".join([*head, *texts[at : at + batch]]) + "]").encode()
                    back = _request(url, body, {"Content-Type": "application/json"}, token, timeout or None).decode()
                    rows = compact_rows(parse_stream(back)[0], prefixes) if head else parse_entities(back)
                    cols = list(zip(*rows)) or [()] * len(_ARROW)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        return entity_json(df).select("json").mapInArrow(work, _ROWS)

    return transform
