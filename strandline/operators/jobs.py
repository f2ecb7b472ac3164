"""Jobs: a small engine on the driver, and queries over job and event tables."""

from __future__ import annotations

import json
import resource
import secrets as rnd
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import Config
from strandline.errors import EngineError

ACTIVE, DONE = ("queued", "running"), ("completed", "failed", "cancelled", "interrupted")
SCHEMA_VERSION = 1


# -- tables --------------------------------------------------------------------------------------


def _seconds(ts: Column) -> Column:
    """Seconds since the epoch, of timestamps with or without a zone."""
    return ts.cast("timestamp").cast("double")


def is_stale(now: Column, stale_ms: int = 30_000) -> Column:
    last = F.coalesce("heartbeat_at", "updated_at", "created_at")
    return F.col("status").isin(*ACTIVE) & ((_seconds(now) - _seconds(last)) * 1000 > stale_ms)


def refresh_stale(jobs: DataFrame, now: Column, stale_ms: int = 30_000) -> DataFrame:
    """Jobs whose owner stopped writing are interrupted."""
    stale = is_stale(now, stale_ms)
    return jobs.withColumns({"status": F.when(stale, "interrupted").otherwise(F.col("status")), "error_code": F.when(stale, "INTERRUPTED").otherwise(F.col("error_code")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at"))})


def eta_seconds(now: Column) -> Column:
    """Seconds left of a running job, from its progress so far; null at the start."""
    elapsed = _seconds(now) - _seconds(F.col("started_at"))
    return F.when((F.col("status") == "running") & (F.col("fraction") > 0.02) & F.col("started_at").isNotNull(), F.round(elapsed / F.col("fraction") * (1 - F.col("fraction"))))


def latest(jobs: DataFrame, n: int | None = None) -> DataFrame:
    ordered = jobs.where(F.col("id").rlike(r"\Aj_[0-9a-f]{12}\z")).orderBy(F.desc("created_at"), "id")
    return ordered if n is None else ordered.limit(n)


def current_state(events: DataFrame) -> DataFrame:
    """Each job's last event, how many there are, and the time its ended stages took."""
    spot = F.struct("ts", "event_no")
    return events.groupBy("job_id").agg(F.max_by("stage", spot).alias("stage"), F.max_by("event", spot).alias("event"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"), F.sum(F.when(F.col("event") == "end", F.col("duration_ms"))).alias("worked_ms"))


#: Seconds of a bucket of time in which running jobs are summed by one task.
BUCKET = 86_400


def peak_concurrency(jobs: DataFrame, by: str = "kind") -> DataFrame:
    """The most jobs of a kind that ran at once; a job that ends when another starts doesn't count with it.

    Sums run inside buckets of time, then over one row a bucket, so no task holds all jobs of a kind.
    """
    marks = jobs.where("started_at is not null and finished_at is not null").select(by, F.explode(F.array(F.struct(F.col("started_at").alias("at"), F.lit(1).alias("d")), F.struct(F.col("finished_at").alias("at"), F.lit(-1).alias("d")))).alias("m")).select(by, "m.*")
    steps = marks.groupBy(by, "at").agg(F.sum("d").alias("d")).withColumn("bucket", F.floor(_seconds(F.col("at")) / BUCKET))
    inside = steps.withColumn("running", F.sum("d").over(Window.partitionBy(by, "bucket").orderBy("at")))
    buckets = inside.groupBy(by, "bucket").agg(F.max("running").alias("top"), F.sum("d").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return buckets.withColumn("top", F.col("top") + before).groupBy(by).agg(F.max("top").alias("peak"))


def collectable(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Jobs that may be removed: older than so many days and not running."""
    return jobs.where((F.col("updated_at") < now - F.expr(f"interval {days if days > 0 else 30} days")) & (F.col("status") != "running"))


# -- engine --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Kind:
    """A kind of job: what it runs, its resource class, its estimated seconds, and what it prepares first."""

    name: str
    run: Callable
    resource: Callable[[dict], str] | str = "light"
    estimate: Callable = lambda params, pre: 60.0
    prepare: Callable = lambda params: None


@dataclass
class Job:
    id: str
    kind: str
    params: dict
    status: str = "queued"
    stage: str = "resolve"
    fraction: float = 0.0
    message: str = ""
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    started_at: datetime | None = None
    finished_at: datetime | None = None
    updated_at: datetime | None = None
    heartbeat_at: datetime | None = None
    error: EngineError | None = None
    result: object = None
    parent_job_id: str | None = None
    estimate: float | None = None

    def record(self) -> dict:
        """The row of the job table, and the error as it was."""
        own = {c: getattr(self, c) for c in ("id", "kind", "status", "stage", "fraction", "message", "created_at", "started_at", "finished_at", "updated_at", "heartbeat_at", "parent_job_id")}
        return {"schema_version": SCHEMA_VERSION, **own, "params": json.dumps(self.params, default=str), "error_code": self.error.code if self.error else None, "error": self.error.as_dict() if self.error else None}

    @classmethod
    def of(cls, record: dict) -> Job:
        times = {c: datetime.fromisoformat(record[c]) if record.get(c) else None for c in ("created_at", "started_at", "finished_at", "updated_at", "heartbeat_at")}
        error = record.get("error")
        return cls(record["id"], record["kind"], json.loads(record.get("params") or "{}"), record["status"], record.get("stage") or "", float(record.get("fraction") or 0), record.get("message") or "", **times, error=EngineError(error["code"], error["message"], error.get("hint")) if error else None, parent_job_id=record.get("parent_job_id"))


def memory_mb() -> int:
    """What this process holds of memory now."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize() >> 20
    except OSError:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10


class Engine:
    """Runs jobs: short ones at once, others on a thread under the limit of their resource class.

    With a store, records, events and results are written as they change, so that other processes see them
    and they outlive this one; a record whose owner stopped writing is found interrupted when it is read.
    A running job's heartbeat is written at fixed times, whether or not it reports progress.  A Spark
    action inside a job carries the job's tag, so cancelling stops its stages.
    """

    def __init__(self, config: Config | None = None, spark: object = None, store: object = None) -> None:
        self.config, self.spark, self.store = config or Config(), spark, store
        self.kinds: dict[str, Kind] = {}
        self.jobs: dict[str, Job] = {}
        self.events: list[dict] = []
        self._slots = {c: threading.Semaphore(n) for c, n in self.config.concurrency.items()}
        self._threads: dict[str, threading.Thread] = {}
        self._stop: dict[str, threading.Event] = {}
        self.list()

    def register(self, kind: Kind) -> None:
        self.kinds[kind.name] = kind

    def _save(self, job: Job) -> None:
        job.updated_at = datetime.now(timezone.utc)
        if self.store is not None:
            self.store.save(job.record())

    def _event(self, job: Job, event: str, **more: object) -> None:
        data = {"memory_mb": memory_mb()} if self.config.debug_memory else {}
        made = {"job_id": job.id, "ts": datetime.now(timezone.utc), "stage": job.stage, "event": event, **more, **({"data": json.dumps(data)} if data else {})}
        self.events.append(made)
        if self.store is not None:
            self.store.append(made)

    def submit(self, kind: str, params: dict, inline: bool | None = None, parent_job_id: str | None = None) -> Job:
        if kind not in self.kinds:
            raise EngineError("INVALID_ARGUMENT", f"unknown job kind {kind}")
        what = self.kinds[kind]
        job = Job("j_" + rnd.token_hex(6), kind, params, parent_job_id=parent_job_id)
        job.heartbeat_at = job.created_at
        self.jobs[job.id], self._stop[job.id] = job, threading.Event()
        self._save(job)
        try:
            pre = what.prepare(params)
            job.estimate = float(what.estimate(params, pre))
        except Exception as e:  # noqa: BLE001 - whatever went wrong is the job's error
            self._end(job, "failed", e)
            self._event(job, "error", message=job.error.message)
            return job
        job.stage, job.message = "queued", "waits for a slot"
        self._save(job)
        at_once = job.estimate <= self.config.inline_seconds > 0 if inline is None else inline
        if at_once:
            self._run(job, what, pre)
        else:
            self._threads[job.id] = threading.Thread(target=self._run, args=(job, what, pre), daemon=True)
            self._threads[job.id].start()
        return job

    def _beat(self, job: Job, done: threading.Event) -> None:
        while not done.wait(self.config.heartbeat_ms / 1000):
            if job.status == "running":
                job.heartbeat_at = datetime.now(timezone.utc)
                try:
                    self._save(job)
                except Exception as e:  # noqa: BLE001 - a missed beat is told, and the next one tried
                    self.events.append({"job_id": job.id, "ts": job.heartbeat_at, "stage": "heartbeat", "event": "info", "message": str(e)})

    def _run(self, job: Job, what: Kind, pre: object) -> None:
        resource_class = what.resource(job.params) if callable(what.resource) else what.resource
        with self._slots[resource_class]:
            if self._stop[job.id].is_set():
                self._end(job, "cancelled", EngineError("CANCELLED", "cancelled before it started"))
                return
            job.status, job.stage, job.started_at, job.message = "running", "starting", datetime.now(timezone.utc), "starting"
            job.heartbeat_at = job.started_at
            self._save(job)
            self._event(job, "start")
            done = threading.Event()
            threading.Thread(target=self._beat, args=(job, done), daemon=True).start()
            if self.spark is not None:
                self.spark.addTag(job.id)
            began = time.monotonic()
            try:
                job.result = what.run(job.params, pre, lambda *a: self._progress(job, *a))
                stopped = self._stop[job.id].is_set()
                if self.store is not None and not stopped:
                    self.store.save_result(job.id, job.result)
                self._end(job, "cancelled" if stopped else "completed", EngineError("CANCELLED", "cancelled") if stopped else None)
            except Exception as e:  # noqa: BLE001 - whatever went wrong is the job's error
                stopped = self._stop[job.id].is_set()
                self._end(job, "cancelled" if stopped else "failed", EngineError("CANCELLED", "cancelled") if stopped else e)
            finally:
                done.set()
                took = int((time.monotonic() - began) * 1000)
                self._event(job, "end" if job.status == "completed" else "error", duration_ms=took, **({"message": job.error.message} if job.error else {}))
                if self.spark is not None:
                    self.spark.removeTag(job.id)

    def _progress(self, job: Job, stage: str, fraction: float, message: str = "") -> None:
        if self._stop[job.id].is_set():
            raise EngineError("CANCELLED", "cancelled")
        job.stage, job.fraction, job.message = stage, min(1.0, max(0.0, fraction)), message or stage
        job.heartbeat_at = datetime.now(timezone.utc)
        self._save(job)
        self._event(job, "progress", message=message)

    def _end(self, job: Job, status: str, error: Exception | None) -> None:
        job.finished_at = datetime.now(timezone.utc)
        if error is not None:
            job.error = error if isinstance(error, EngineError) else EngineError("INTERNAL", str(error))
        elif status == "completed":
            job.fraction, job.stage, job.message = 1.0, "done", "completed"
        job.status = status
        self._save(job)

    def _fresh(self, job: Job) -> Job:
        """A job as its record has it; interrupted if it is another process's that stopped writing."""
        if job.id in self.jobs or job.status not in ACTIVE:
            return job
        quiet = datetime.now(timezone.utc) - (job.heartbeat_at or job.updated_at or job.created_at)
        if quiet.total_seconds() * 1000 > self.config.stale_after_ms:
            said = "while this job ran" if job.status == "running" else "before this job started"
            self._end(job, "interrupted", EngineError("INTERRUPTED", f"the process that owned it stopped {said}", "submit it again"))
        return job

    def cancel(self, job_id: str) -> Job:
        """The job after the change; a finished one is unchanged, and another process's running one can't be stopped from here."""
        job = self.get(job_id)
        if job.status in DONE:
            return job
        if job_id not in self.jobs:
            if job.status == "running":
                raise EngineError("JOB_NOT_DONE", f"job {job_id} runs in another process", "cancel it there, or wait until its heartbeat is stale")
            self._end(job, "cancelled", EngineError("CANCELLED", "cancelled before it started"))
            return job
        self._stop[job_id].set()
        if self.spark is not None:
            self.spark.interruptTag(job_id) if hasattr(self.spark, "interruptTag") else self.spark.sparkContext.cancelJobsWithTag(job_id)
        if job.status == "queued":
            self._end(job, "cancelled", EngineError("CANCELLED", "cancelled before it started"))
        return job

    def get(self, job_id: str) -> Job:
        if job_id in self.jobs:
            return self.jobs[job_id]
        record = self.store.load(job_id) if self.store is not None else None
        if record is None:
            raise EngineError("JOB_NOT_FOUND", f"no job {job_id}")
        return self._fresh(Job.of(record))

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        if job_id in self._threads:
            self._threads[job_id].join(timeout)
        return self.get(job_id)

    def result(self, job_id: str) -> object:
        job = self.get(job_id)
        if job.status != "completed":
            raise EngineError("JOB_NOT_DONE", f"job {job_id} is {job.status}")
        return job.result if job_id in self.jobs else self.store.load_result(job_id)

    def list(self) -> list[Job]:
        """All jobs that this process or the store knows, newest first."""
        others = [self.store.load(i) for i in self.store.ids() if i not in self.jobs] if self.store is not None else []
        every = [replace(j) for j in self.jobs.values()] + [self._fresh(Job.of(r)) for r in others if r]
        return sorted(every, key=lambda j: j.created_at, reverse=True)

    def estimate(self, kind: str, params: dict) -> float:
        if kind not in self.kinds:
            raise EngineError("INVALID_ARGUMENT", f"unknown job kind {kind}")
        what = self.kinds[kind]
        return float(what.estimate(params, what.prepare(params)))

    def remove(self, job_id: str) -> None:
        if self.get(job_id).status in ACTIVE:
            raise EngineError("JOB_NOT_DONE", f"job {job_id} is active")
        self.jobs.pop(job_id, None)
        if self.store is not None:
            self.store.remove(job_id)
