"""Exactly the rows not yet covered by a job's last successful run.

Offsets are kept per source partition (dataset); a run's batch plan is written before
anything is read, replayed as written after a failure, and its rows carry their key and
offset, so a sink that already holds some of them takes each once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..shared import SharedFiles

#: Rows of one dataset that one planned batch covers.
BATCH_SPAN = 4096
#: Batches that one row of a plan is cut into at a time.
_STRIDE = 1024
#: Up to this many datasets' ranges are filters that reach the scan of a sink; more are joined.
_INLINE_RANGES = 256

_UNION = "struct<Tokens:array<struct<Token:string>>,DatasetNames:array<string>>"
_MULTI = "struct<MainToken:string,DependencyTokens:map<string,struct<Token:string>>>"


def plain_offset(token: Column) -> Column:
    """An offset written as decimal text or as base64 of decimal text; anything else is null."""
    text = F.trim(token)
    b64 = F.try_to_binary(text, F.lit("base64")).cast("string")
    number = lambda c: F.when(c.rlike("^[0-9]{1,19}$"), c.cast("bigint"))
    return F.coalesce(number(text), number(b64))


def job_offsets(runs: DataFrame) -> DataFrame:
    """``(job_id, dataset, offset)``: what each job's last successful run left to do.

    The last successful run is the one of the highest ``run_no`` with ``lastrunok`` true
    (repeats of a run: the latest end, then the greatest token); jobs without one, or whose token is
    null, empty or of no known shape, start at 0. A dataset that a composite token does
    not name starts at 0 too. Datasets are those of ``source_names`` of the highest run.
    """
    ok = F.coalesce(F.col("lastrunok"), F.lit(False))
    best = (
        runs.where(F.col("job_id").isNotNull())
        .groupBy("job_id")
        .agg(
            F.max(F.struct(F.coalesce("run_no", F.lit(-1)).alias("r"), F.col("source_names").alias("names"))).alias("last"),
            F.max(F.when(ok, F.struct(F.coalesce("run_no", F.lit(-1)).alias("r"), F.col("ended_at").alias("e"), F.col("token").alias("token")))).alias("good"),
        )
        .select("job_id", F.from_json("last.names", "array<string>").alias("names"), F.trim("good.token").alias("token"))
    )
    union, multi = F.from_json("token", _UNION), F.from_json("token", _MULTI)
    is_json = F.col("token").startswith("{")
    parsed = best.select(
        "job_id",
        "names",
        "token",
        F.when(is_json, union).alias("u"),
        F.when(is_json, multi).alias("m"),
        F.posexplode(F.array_distinct("names")).alias("pos", "dataset"),
    ).where("dataset IS NOT NULL")
    at = F.array_position("u.DatasetNames", F.col("dataset"))
    raw = (
        F.when(F.col("u.Tokens").isNotNull(), F.when(at > 0, F.try_element_at("u.Tokens", at.cast("int"))["Token"]))
        .when(F.col("m.MainToken").isNotNull() & (F.col("pos") == 0), F.col("m.MainToken"))
        .when(F.col("m").isNotNull(), F.col("m.DependencyTokens")[F.col("dataset")]["Token"])
        .otherwise(F.col("token"))
    )
    return parsed.select("job_id", "dataset", F.coalesce(plain_offset(raw), F.lit(0).cast("bigint")).alias("offset"))


def plan_batches(offsets: DataFrame, log: DataFrame, span: int = BATCH_SPAN) -> DataFrame:
    """``(job_id, dataset, batch, from_seq, to_seq)``: the open ranges, cut at multiples of ``span``.

    Ends are the datasets' last rows now, so rows that arrive while the plan is worked
    off belong to the next run. Datasets without open rows get no batch.
    """
    ends = log.where("dataset IS NOT NULL AND seq IS NOT NULL").groupBy("dataset").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    start = F.greatest("offset", "first")
    return cut_ranges(offsets.join(ends, "dataset").where(F.col("last") >= start).select("job_id", "dataset", start.alias("start"), "last"), span)


def cut_ranges(open_: DataFrame, span: int = BATCH_SPAN) -> DataFrame:
    """The batches of :func:`plan_batches` of ranges ``(job_id, dataset, start, last)``."""
    # two steps, so that no single row ever holds the list of all batches of a long range
    step = lambda c, n: F.floor(F.col(c) / n).cast("bigint")
    wide = span * _STRIDE
    strides = open_.withColumn("stride", F.explode(F.sequence(step("start", wide), step("last", wide))))
    first = F.greatest(step("start", span), F.col("stride") * _STRIDE)
    final = F.least(step("last", span), F.col("stride") * _STRIDE + (_STRIDE - 1))
    cut = strides.withColumn("batch", F.explode(F.sequence(first, final)))
    return cut.select(
        "job_id",
        "dataset",
        "batch",
        F.greatest("start", F.col("batch") * span).alias("from_seq"),
        F.least("last", F.col("batch") * span + (span - 1)).alias("to_seq"),
    )


def read_planned(plan: DataFrame, log: DataFrame, span: int = BATCH_SPAN, payload: tuple[str, ...] = ()) -> DataFrame:
    """The log rows of a batch plan as ``(job_id, dataset, seq, *payload)``, each once.

    Log rows are first reduced to one per (dataset, seq): repeated rows of the log must
    not be processed twice. The join is on (dataset, batch), never on the dataset alone,
    so a hot dataset is spread over its batches and no pair outside a planned batch is
    looked at. With repeats that differ, the greatest payload is taken.
    """
    rows = log.where("dataset IS NOT NULL AND seq IS NOT NULL").select("dataset", "seq", F.floor(F.col("seq") / span).cast("bigint").alias("batch"), *payload)
    # reduced on the map side first, so any number of copies of a row travels once per task
    if payload:
        rows = rows.groupBy("dataset", "batch", "seq").agg(F.max(F.struct(*payload)).alias("p")).select("dataset", "batch", "seq", "p.*")
    else:
        rows = rows.dropDuplicates(["dataset", "batch", "seq"])
    hit = (F.col("seq") >= F.col("from_seq")) & (F.col("seq") <= F.col("to_seq"))
    return rows.join(plan, ["dataset", "batch"]).where(hit).select("job_id", "dataset", "seq", *payload)


def open_rows(runs: DataFrame, log: DataFrame, span: int = BATCH_SPAN, payload: tuple[str, ...] = ()) -> DataFrame:
    """All rows every job must process next; the plan is written before it is read."""
    plan = materialise(plan_batches(job_offsets(runs), log, span), "batch-plan")
    return read_planned(plan, log, span, payload)


class IncrementalRun:
    """One job's consumption of a log, with a write-ahead plan in ``folder``.

    ``begin`` returns the rows of the pending plan if an earlier run wrote one and did not
    commit, else plans from the committed offsets, writes that plan and returns its rows.
    ``commit`` moves the offsets to the plan's ends. A failure between the two repeats the
    same rows, which :func:`sink_once` takes only once. ``folder`` must be shared storage.
    """

    def __init__(self, folder: str, job_id: str, datasets: list[str], span: int = BATCH_SPAN):
        self.job_id, self.datasets, self.span = job_id, datasets, span
        self._files = SharedFiles(folder)

    def offsets(self) -> dict[str, int]:
        return (self._files.get("offsets") or {"offsets": {}})["offsets"]

    def begin(self, log: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
        spark = log.sparkSession
        pending, done = self._files.get("plan"), self.offsets()
        if pending and all(done.get(d, 0) > z for d, (_, z) in pending["ranges"].items()):
            pending = None  # committed, but stopped before the plan was removed
        if pending is None:
            schema = "job_id string, dataset string, offset bigint"
            rows = [(self.job_id, d, done.get(d, 0)) for d in self.datasets]
            wanted = plan_batches(spark.createDataFrame(rows, schema), log.where(F.col("dataset").isin(self.datasets)), self.span)
            ranges = wanted.groupBy("dataset").agg(F.min("from_seq").alias("a"), F.max("to_seq").alias("b")).collect()
            pending = {"ranges": {r.dataset: [r.a, r.b] for r in ranges}}
            self._files.put("plan", pending)
        ranges = [(self.job_id, d, a, z) for d, (a, z) in pending["ranges"].items()]  # one per dataset; Spark cuts them into batches
        return read_planned(cut_ranges(spark.createDataFrame(ranges, "job_id string, dataset string, start bigint, last bigint"), self.span), log, self.span, payload)

    def delivered(self, sink: DataFrame) -> DataFrame:
        """The rows of a sink (with dataset and seq) that lie in the ranges of the pending plan: all that a replay can repeat."""
        ranges = (self._files.get("plan") or {"ranges": {}})["ranges"]
        if len(ranges) <= _INLINE_RANGES:
            inside = [(F.col("dataset") == d) & F.col("seq").between(a, z) for d, (a, z) in ranges.items()]
            return sink.where(reduce(lambda a, b: a | b, inside, F.lit(False)))
        table = sink.sparkSession.createDataFrame([(d, a, z) for d, (a, z) in ranges.items()], "dataset string, __from bigint, __to bigint")
        return sink.join(table, "dataset").where(F.col("seq").between(F.col("__from"), F.col("__to"))).select(*sink.columns)

    def commit(self) -> None:
        pending = self._files.get("plan")
        if pending is None:
            return
        done = self.offsets()
        done.update({d: z + 1 for d, (_, z) in pending["ranges"].items()})
        self._files.put("offsets", {"offsets": done})
        self._files.remove("plan")


def sink_once(sink: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("job_id", "dataset", "seq")) -> DataFrame:
    """The rows of a (replayed) batch that ``sink`` does not hold yet, each once; see :meth:`IncrementalRun.delivered` for what of a sink is needed."""
    return rows.dropDuplicates(list(keys)).join(sink.select(*keys), list(keys), "left_anti")
