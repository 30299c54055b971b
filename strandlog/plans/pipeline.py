"""Jobs: source, transform and sink, run in full or incrementally with tokens."""

from __future__ import annotations

import logging
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark import InheritableThread, SparkContext
from pyspark.sql import DataFrame

from ..shared import SharedFiles
from ..sources.readers import DatasetSource, MultiSource, Source, UnionDatasetSource
from ..sources.sinks import HttpDatasetSink, Sink
from .schedule import Schedule

Transform = Callable[[DataFrame], DataFrame]

_log = logging.getLogger(__name__)

#: Changes one step of an incremental run reads.
BATCH = 10_000

#: Failed rows of a run that are kept for a look at them.
KEPT_FAILED = 1_000

#: The keys that job configurations and their triggers have.
_JOB_KEYS = {"id", "title", "description", "tags", "source", "sink", "transform", "triggers", "paused", "batchSize", "hops", "transactions"}
_TRIGGER_KEYS = {"triggerType", "jobType", "schedule", "monitoredDataset", "onError"}


class JobState:
    """Tokens, run history and pause flags of jobs, one JSON file each, replaced in one step."""

    def __init__(self, folder: str):
        self._files = SharedFiles(folder)

    def load(self, job: str) -> dict:
        return self._files.get(quote(job, safe="")) or {"token": "", "history": [], "paused": False}

    def save(self, job: str, state: dict) -> None:
        self._files.put(quote(job, safe=""), state)

    def remove(self, job: str) -> None:
        self._files.remove(quote(job, safe=""))

    def jobs(self) -> list[str]:
        return [unquote(n) for n in self._files.names()]

    def update(self, job: str, **values: object) -> None:
        self.save(job, {**self.load(job), **values})


class Killed(Exception):
    """The run was told to stop; ``processed`` is what it had stored with its token."""

    def __init__(self, processed: int):
        super().__init__("killed")
        self.processed = processed


class TooManyFailed(Exception):
    """More rows of a run failed than its policy lets pass."""


@dataclass
class ErrorPolicy:
    """What a failing step does.

    ``skip``: halve the failing batch down to the single rows that fail, leave those out
    (they are logged and counted, the first ``KEPT_FAILED`` are kept in ``failed``) and go on; the run fails once there are ``max_items`` of
    them, 0 means that there may be any number. ``rerun``: run the job again up to
    ``retries`` times after ``delay`` seconds. Everything counts per run.
    """

    skip: bool = False
    max_items: int = 0
    retries: int = 0
    delay: float = 30.0

    @classmethod
    def from_trigger(cls, trigger: dict) -> "ErrorPolicy":
        """From a trigger's ``onError``; ``maxItems`` 0 or absent skips all failing rows, a rerun is 1 after 30 seconds unless told otherwise."""
        held = {h["errorHandler"].lower(): h for h in trigger.get("onError") or []}
        if "requeue" in held:
            raise ValueError("the error handler reQueue is not supported")
        policy = cls()
        if "log" in held:
            policy.skip, policy.max_items = True, int(held["log"].get("maxItems") or 0)
        if "rerun" in held:
            given = held["rerun"]
            policy.retries, policy.delay = int(given.get("maxRetries") or 1), float(given.get("retryDelay") or 30)
        return policy


def error_policies(triggers: list[dict]) -> dict[str, ErrorPolicy]:
    """The policy of each job type; full runs are one write, so they cannot leave single rows out."""
    found: dict[str, ErrorPolicy] = {}
    for t in triggers:
        kind, policy = t["jobType"].lower(), ErrorPolicy.from_trigger(t)
        if policy.skip and kind == "fullsync":
            raise ValueError("the error handler log is not supported for fullsync triggers")
        if found.setdefault(kind, policy) != policy:
            raise ValueError(f"{kind} triggers with different error handlers")
    return found


@dataclass
class Pipeline:
    """One job. ``key`` orders rows for halving; rows of a batch are few by construction.

    ``full_errors``, if given, is the policy of full runs in place of ``errors``.
    """

    job: str
    source: Source
    sink: Sink
    state: JobState
    transforms: list[Transform] = field(default_factory=list)
    batch: int | None = BATCH
    errors: ErrorPolicy = field(default_factory=ErrorPolicy)
    full_errors: ErrorPolicy | None = None
    key: str = "entity_id"
    failed: list[dict] = field(default_factory=list)
    n_failed: int = 0
    last_error: str | None = None
    processed: int = 0
    cancelled: threading.Event = field(default_factory=threading.Event)

    def _apply(self, rows: DataFrame) -> DataFrame:
        for t in self.transforms:
            rows = t(rows)
        return rows

    def _write(self, rows: DataFrame, whole: bool = False) -> int:
        out = self._apply(rows)
        return self.sink.write_all(out) if whole else self.sink.write(out)

    def _step(self, rows: DataFrame) -> int:
        try:
            return self._write(rows)
        except Exception as error:
            if not self.errors.skip:
                raise
            self.last_error = str(error)
            return self._halve(rows, error)

    def _halve(self, rows: DataFrame, error: Exception) -> int:
        """Works off the two halves of a failed batch; a single row that fails is set aside."""
        n = rows.count()
        if n <= 1:
            for row in rows.collect():
                _log.warning("job %s: entity %s failed: %s", self.job, row.asDict().get(self.key), error)
                self.n_failed += 1
                if len(self.failed) < KEPT_FAILED:
                    self.failed.append(row.asDict())
            if 0 < self.errors.max_items <= self.n_failed:
                raise TooManyFailed(f"{self.n_failed} rows failed, the last with: {error}") from error
            return 0
        spark, done = rows.sparkSession, 0
        ordered = sorted(rows.collect(), key=lambda r: r[self.key] or "")  # one batch, at most self.batch rows
        for half in (ordered[: n // 2], ordered[n // 2 :]):
            part = spark.createDataFrame(half, rows.schema)
            try:
                done += self._write(part)
            except TooManyFailed:
                raise
            except Exception as e:
                done += self._halve(part, e)
        return done

    def run_incremental(self) -> int:
        """Reads, transforms and writes step by step; the token is stored after every step.

        A failure repeats at most the last step, whose equal versions the sink ignores. A
        multi source without a token runs in full once.
        """
        processed = self.processed = 0
        while not self.cancelled.is_set():
            token = self.state.load(self.job)["token"]
            if not token and isinstance(self.source, MultiSource):
                return self.run_full()
            rows, following = self.source.read(token, self.batch)
            rows = rows.persist()
            try:
                n = rows.count()
                if n:
                    self._step(rows)
            finally:
                rows.unpersist()
            processed = self.processed = processed + n
            self.state.update(self.job, token=following)
            if not n or following == token or not following or isinstance(self.source, MultiSource):
                break
        else:
            raise Killed(processed)
        return processed

    def run_full(self) -> int:
        """Reads everything, writes it as a full sync and then stores the token.

        A local sink gets every change of plain dataset sources, so its history follows
        theirs; a remote sink, sources of newest versions only and multi sources give
        entities. A remote sink gets no token from a plain source, because the remote may
        have lost the sync.
        """
        self.state.update(self.job, token="")
        remote = isinstance(self.sink, HttpDatasetSink)
        newest = isinstance(self.source, MultiSource) or getattr(self.source, "latest_only", False)
        history = isinstance(self.source, (DatasetSource, UnionDatasetSource)) and not remote and not newest
        rows, following = self.source.read("") if history else self.source.read_all()
        n = rows.count()
        if self.cancelled.is_set():
            raise Killed(0)
        self._write(rows, whole=True)
        if not remote or newest:
            self.state.update(self.job, token=following)
        return n

    @property
    def group(self) -> str:
        """The group of the Spark jobs of a run."""
        return f"strandlog-job-{self.job}"

    def kill(self) -> None:
        """Ends the run that is going on: its Spark jobs are cancelled, and no further step begins."""
        self.cancelled.set()
        context = SparkContext._active_spark_context
        if context is not None:
            context.cancelJobGroup(self.group)

    def run(self, full: bool = False) -> dict:
        """One run with its policy for errors; its record goes to the job's history."""
        started, tries = time.time(), 0
        errors = self.full_errors if full and self.full_errors is not None else self.errors
        self.cancelled.clear()  # an earlier kill ended an earlier run
        context = SparkContext.getOrCreate()  # a new thread has no active session, but the same context
        context.setJobGroup(self.group, f"job {self.job}", interruptOnCancel=True)
        try:
            while True:
                self.failed, self.n_failed, self.last_error, self.processed = [], 0, None, 0
                try:
                    processed, error = (self.run_full() if full else self.run_incremental()), None
                except Killed as e:
                    processed, error = e.processed, str(e)
                except Exception as e:
                    # a kill also cancels the Spark jobs of the run, which fail then
                    processed, error = (self.processed, "killed") if self.cancelled.is_set() else (0, str(e))
                if error is None or self.cancelled.is_set() or tries >= errors.retries:
                    break
                tries += 1
                self.cancelled.wait(errors.delay)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
        record = {"full": full, "ok": error is None, "error": error or self.last_error, "started": started, "ended": time.time(), "processed": processed, "skipped": self.n_failed}
        held = self.state.load(self.job)
        self.state.update(self.job, history=[*held["history"], record])
        return record


class Raffle:
    """Tickets: one run per job at a time, and a limit each for full and incremental runs."""

    def __init__(self, full: int = 10, incremental: int = 10):
        self._free = {True: full, False: incremental}
        self._running: dict[str, bool] = {}
        self._lock = threading.Lock()

    def take(self, job: str, full: bool) -> bool:
        with self._lock:
            if job in self._running or not self._free[full]:
                return False
            self._free[full] -= 1
            self._running[job] = full
            return True

    def give_back(self, job: str) -> None:
        with self._lock:
            full = self._running.pop(job, None)
            if full is not None:
                self._free[full] += 1

    def running(self) -> list[str]:
        with self._lock:
            return sorted(self._running)


class EventBus:
    """Calls what is subscribed to the topics of a regular expression, in order of subscription."""

    def __init__(self) -> None:
        self._subscribers: dict[str, tuple[re.Pattern, Callable[[str], None]]] = {}
        self._lock = threading.Lock()

    def subscribe(self, name: str, topics: str, call: Callable[[str], None]) -> None:
        """Subscribes ``name``, replacing an earlier subscription of it."""
        with self._lock:
            self._subscribers[name] = (re.compile(topics), call)

    def unsubscribe(self, name: str) -> None:
        with self._lock:
            self._subscribers.pop(name, None)

    def emit(self, topic: str) -> list[str]:
        """The subscribers called; a failing one does not keep others from being called."""
        with self._lock:
            due = [(n, call) for n, (pattern, call) in self._subscribers.items() if pattern.fullmatch(topic)]
        for name, call in due:
            try:
                call(topic)
            except Exception:
                _log.exception("subscriber %s failed on %s", name, topic)
        return [n for n, _ in due]


class JobManager:
    """Adds, lists, runs, pauses, resumes, kills and resets jobs."""

    def __init__(self, state: JobState, raffle: Raffle | None = None):
        self.state, self.raffle = state, raffle or Raffle()
        self._jobs: dict[str, tuple[Pipeline, dict]] = {}
        self._due: dict[tuple[str, int], float | None] = {}
        self._clock: threading.Thread | None = None
        self._stop = threading.Event()

    @staticmethod
    def verify(config: dict) -> None:
        """Checks a whole job configuration, every trigger and error handler of it."""
        for part in ("id", "title", "source", "sink"):
            if not config.get(part):
                raise ValueError(f"a job needs {part}")
        if unknown := set(config) - _JOB_KEYS:
            raise ValueError(f"a job does not know {sorted(unknown)}")
        if not config.get("triggers"):
            raise ValueError("a job needs a trigger")
        for t in config["triggers"]:
            if unknown := set(t) - _TRIGGER_KEYS:
                raise ValueError(f"a trigger does not know {sorted(unknown)}")
            if str(t.get("jobType")).lower() not in ("fullsync", "incremental"):
                raise ValueError("jobType must be fullsync or incremental")
            if t.get("triggerType") == "cron":
                if not t.get("schedule"):
                    raise ValueError("a cron trigger needs a schedule")
                Schedule.parse(t["schedule"])
            elif t.get("triggerType") == "onchange":
                if not t.get("monitoredDataset"):
                    raise ValueError("an onchange trigger needs a monitoredDataset")
            else:
                raise ValueError("triggerType must be cron or onchange")
            kinds = [str(h.get("errorHandler")).lower() for h in t.get("onError") or []]
            if len(kinds) != len(set(kinds)):
                raise ValueError("an error handler is given twice")
            if unknown := set(kinds) - {"log", "rerun", "requeue"}:
                raise ValueError(f"unknown error handler {sorted(unknown)}")

    def add(self, config: dict, pipeline: Pipeline, keep: bool = False) -> None:
        """Adds or replaces a job; ``keep`` stores its configuration, from which :meth:`stored` gives it after a restart."""
        self.verify(config)
        for name, (_, other) in self._jobs.items():
            if name != config["id"] and other["title"] == config["title"]:
                raise ValueError(f"the title {config['title']} is taken by {name}")
        self._jobs[config["id"]] = (pipeline, config)
        self._due = {k: at for k, at in self._due.items() if k[0] != config["id"]}
        self.state.update(config["id"], paused=bool(config.get("paused")), config=config if keep else None)

    def stored(self) -> list[dict]:
        """The configurations of jobs that are kept, with their pause flags as they are now."""
        states = [self.state.load(j) for j in self.state.jobs()]
        return [{**s["config"], "paused": s["paused"]} for s in states if s.get("config")]

    def delete(self, job: str) -> None:
        self._jobs.pop(job)
        self._due = {k: at for k, at in self._due.items() if k[0] != job}
        self.state.remove(job)

    def jobs(self) -> list[str]:
        return sorted(self._jobs)

    def run(self, job: str, full: bool = False) -> dict | None:
        """The run's record; None if the job is paused, running already or has no ticket."""
        if self.state.load(job)["paused"] or not self.raffle.take(job, full):
            return None
        try:
            return self._jobs[job][0].run(full)
        finally:
            self.raffle.give_back(job)

    def on_change(self, dataset: str) -> list[str]:
        """Runs the jobs that watch ``dataset``; their names."""
        ran = []
        for name, (_, config) in sorted(self._jobs.items()):
            for t in config["triggers"]:
                if t["triggerType"] == "onchange" and t["monitoredDataset"] == dataset and self.run(name, t["jobType"].lower() == "fullsync") is not None:
                    ran.append(name)
        return ran

    def attach(self, bus: EventBus) -> None:
        """Lets changes of a dataset, announced as ``dataset.<name>``, run the jobs that watch it."""
        bus.subscribe("jobs", r"dataset\..*", lambda topic: self.on_change(topic.removeprefix("dataset.")))

    def schedules(self) -> list[tuple[str, str, str]]:
        """(job, job type, schedule) of all cron triggers."""
        return [(n, t["jobType"], t["schedule"]) for n, (_, c) in sorted(self._jobs.items()) for t in c["triggers"] if t["triggerType"] == "cron"]

    def due(self, now: float) -> list[tuple[str, bool]]:
        """(job, whether in full) of the cron triggers that came due since they were last asked for.

        A trigger counts from when it is first seen. One that was missed several times is due once.
        """
        out = []
        for name, (_, config) in sorted(self._jobs.items()):
            for n, t in enumerate(config["triggers"]):
                if t["triggerType"] != "cron":
                    continue
                schedule = Schedule.parse(t["schedule"])
                if (name, n) not in self._due:
                    self._due[name, n] = schedule.after(now)
                at = self._due[name, n]
                if at is not None and at <= now:
                    self._due[name, n] = schedule.after(now)
                    out.append((name, t["jobType"].lower() == "fullsync"))
        return out

    def tick(self, now: float | None = None) -> list[str]:
        """Runs the jobs that are due, one after another; the names of those that ran."""
        return [name for name, full in self.due(time.time() if now is None else now) if self.run(name, full) is not None]

    def start(self, interval: float = 1.0) -> None:
        """Lets a clock run what is due, each run in a thread of its own, until :meth:`stop`."""
        self.due(time.time())
        self._stop.clear()

        def beat() -> None:
            while not self._stop.wait(interval):
                for name, full in self.due(time.time()):
                    InheritableThread(target=self.run, args=(name, full), daemon=True).start()

        self._clock = InheritableThread(target=beat, daemon=True)
        self._clock.start()

    def stop(self) -> None:
        """Ends the clock and kills what runs."""
        self._stop.set()
        if self._clock is not None:
            self._clock.join()
            self._clock = None
        for name in self.status():
            self.kill(name)

    def config(self, job: str) -> dict:
        return self._jobs[job][1]

    def reset_meta(self, job: str) -> None:
        """Forgets the job's history."""
        self.state.update(job, history=[])

    def pause(self, job: str) -> None:
        self.state.update(job, paused=True)

    def resume(self, job: str) -> None:
        self.state.update(job, paused=False)

    def kill(self, job: str) -> None:
        """Stops a running job."""
        self._jobs[job][0].kill()

    def reset_token(self, job: str, token: str = "") -> None:
        self.state.update(job, token=token)

    def history(self, job: str) -> list[dict]:
        return self.state.load(job)["history"]

    def status(self) -> list[str]:
        return self.raffle.running()


def per_batch(function: Callable, schema: str, workers: int | None = None) -> Transform:
    """A user transform over batches: ``function(pandas frame) -> pandas frame``, run by Arrow.

    ``workers`` spreads the rows over as many tasks. What the function looks up is a
    snapshot given to it, not the live store.
    """

    def transform(df: DataFrame) -> DataFrame:
        spread = df.repartition(workers) if workers else df
        return spread.mapInPandas(lambda it: (function(pdf) for pdf in it), schema)

    return transform

