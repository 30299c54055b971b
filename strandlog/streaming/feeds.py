"""The change log as a stream: jobs in micro-batches and a running current state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import Sink


def stream_changes(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """New batches below ``path`` as a stream; Spark keeps the offsets in the query's checkpoint."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_job(changes: DataFrame, sink: Sink, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, datasets: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """An incremental job on a stream of changes.

    A micro-batch is written by the sink and then committed; after a failure it comes
    again as it was, and the sink ignores versions equal to what it has. ``once`` works
    off what is there and ends, otherwise the query goes on: the trigger on change.
    """
    rows = changes.where(F.col("dataset").isin(datasets)) if datasets else changes

    def write(batch: DataFrame, _: int) -> None:
        sink.write(transform(batch) if transform else batch)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_STATE = "recorded bigint, batch_seq bigint, deleted boolean, props string, refs string"
_OUT = "dataset string, entity_id string, " + _STATE


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    best = held
    for pdf in frames:
        row = pdf.sort_values(["recorded", "batch_seq"], kind="stable").iloc[-1]
        if best is None or (row.recorded, row.batch_seq) > (best[0], best[1]):
            best = (int(row.recorded), int(row.batch_seq), bool(row.deleted), row.props, row.refs)
    if best is not None and best != held:
        state.update(best)
        yield pd.DataFrame([(*key, *best)], columns=["dataset", "entity_id", "recorded", "batch_seq", "deleted", "props", "refs"])


def running_state(changes: DataFrame) -> DataFrame:
    """A stream of newest versions: a row whenever an entity gets a newer version than all before.

    Late and repeated versions change nothing, in whatever order they come.
    """
    return changes.groupBy("dataset", "entity_id").applyInPandasWithState(_newest, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def change_counts(changes: DataFrame, late: str | None = None, window: str = "1 day") -> DataFrame:
    """Changes per dataset and window of their recorded time, for update or complete mode.

    However late a change arrives it is counted; the state is one row per window and
    dataset. With ``late`` Spark may forget windows older than that, and changes that
    arrive for them are not counted.
    """
    timed = changes.withColumn("at", F.timestamp_micros(F.floor(F.col("recorded") / 1000).cast("bigint")))
    timed = timed if late is None else timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "dataset").agg(F.count(F.lit(1)).alias("n_changes"), F.sum(F.col("deleted").cast("int")).alias("n_deleted"))
