"""Entity endpoints and virtual datasets as Spark data sources and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.functions import udtf

from .http import get_page

SCHEMA = "entity_id string, recorded bigint, deleted boolean, props string, refs string"


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition: object) -> Iterator[tuple]:
        since = self.options.get("since")
        while True:
            rows, following = get_page(self.options["url"], since, int(self.options["limit"]) if "limit" in self.options else None)
            yield from rows
            if not rows or following is None or following == since:
                return
            since = following


class _Stream(SimpleDataSourceStreamReader):
    """The offset is the remote's continuation token and the number of rows read up to it.

    After a failure the rows between two offsets are asked for again by their number, so
    a batch comes again as it was, also if the remote has more by then.
    """

    def __init__(self, options: dict):
        self.options = options
        self.limit = int(options["limit"]) if "limit" in options else None

    def initialOffset(self) -> dict:
        return {"token": self.options.get("since", ""), "rows": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, following = get_page(self.options["url"], start["token"] or None, self.limit)
        return iter(rows), {"token": following or start["token"], "rows": start["rows"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        token, left = start["token"], end["rows"] - start["rows"]
        while left > 0:
            rows, following = get_page(self.options["url"], token or None, left)
            yield from rows[:left]
            left -= len(rows)
            if left > 0 and (not rows or following in (None, token)):
                raise RuntimeError("the remote no longer has all rows of a batch that must be repeated")
            token = following


class EntityEndpoint(DataSource):
    """``spark.read.format("entities").option("url", ...)``, also ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "entities"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def register_endpoint(spark: SparkSession) -> None:
    spark.dataSource.register(EntityEndpoint)


def register_virtual(spark: SparkSession, name: str, build: Callable[[str, int], Iterator[tuple]]) -> None:
    """A virtual dataset as table function ``name(since, limit)``; ``build`` yields entity rows."""

    class Rows:
        def eval(self, since: str, limit: int) -> Iterator[tuple]:
            yield from build(since, limit)

    spark.udtf.register(name, udtf(Rows, returnType=SCHEMA))
