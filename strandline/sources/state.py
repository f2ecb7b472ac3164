"""State on disk: job records, event logs, results."""

from __future__ import annotations

import json
import re
import threading
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.errors import EngineError


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JOBS).option("multiLine", "true").json(path)


def write_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JOB_EVENTS).json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.JOB_EVENTS).json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of a result table where the new ones win."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def usable(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Cached results all of whose artifacts are still there; ``artifacts`` is an array of paths."""
    gone = cached.select("key", F.explode("artifacts").alias("path")).join(files.select("path"), "path", "left_anti").select("key").distinct()
    return cached.join(gone, "key", "left_anti")


def adopted(cached: DataFrame, job_id: str, root: str) -> DataFrame:
    """Cached results with their artifacts' paths in the folder of another job."""
    return cached.withColumn("artifacts", F.transform("artifacts", lambda p: F.concat(F.lit(f"{root}/{job_id}/artifacts/"), F.regexp_replace(p, r"\A.*/", ""))))


def known_timings(runs: DataFrame, before: DataFrame) -> DataFrame:
    """Runs (fixture, cached, seconds): what a cached result took is the earlier run's time, if there was one."""
    old = before.select("fixture", F.col("seconds").alias("__before"))
    return runs.join(old, "fixture", "left").withColumn("seconds", F.when(F.col("cached"), F.coalesce("__before", "seconds")).otherwise(F.col("seconds"))).drop("__before")


class JobStore:
    """Job records, events and results, a small file each, in a folder that Spark reads as tables.

    A record is written beside its place and moved there, so readers see the old one or the new one.  An
    event is a file of its own, so several processes may write.  What can't be read is no record.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._lock, self._events = spark, root.rstrip("/"), threading.Lock(), 0
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _write(self, folder: str, name: str, text: str) -> None:
        place, part = self._path(f"{self.root}/{folder}/{name}"), self._path(f"{self.root}/{folder}/_{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        with self._lock:
            self._fs.delete(place, False)
            self._fs.rename(part, place)

    def _read(self, folder: str, name: str) -> dict | None:
        place = self._path(f"{self.root}/{folder}/{name}")
        if not self._fs.exists(place):
            return None
        stream = self._fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    @staticmethod
    def _checked(job_id: str) -> str:
        if not re.fullmatch("j_[0-9a-f]{12}", job_id):
            raise EngineError("INVALID_ARGUMENT", f"{job_id} is no job id")
        return job_id

    def save(self, record: dict) -> None:
        self._write("jobs", self._checked(record["id"]) + ".json", json.dumps(record, default=_plain))

    def load(self, job_id: str) -> dict | None:
        return self._read("jobs", job_id + ".json") if re.fullmatch("j_[0-9a-f]{12}", job_id) else None

    def save_result(self, job_id: str, result: object) -> None:
        self._write("results", self._checked(job_id) + ".json", json.dumps({"result": result}, default=_plain))

    def load_result(self, job_id: str) -> object:
        found = self._read("results", self._checked(job_id) + ".json")
        return None if found is None else found["result"]

    def append(self, event: dict) -> None:
        with self._lock:
            self._events += 1
            n = self._events
        self._write("events", f"{self._checked(event['job_id'])}-{uuid.uuid4().hex[:8]}-{n:06d}.json", json.dumps(event, default=_plain))

    def ids(self) -> list[str]:
        folder = self._path(f"{self.root}/jobs")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return [n[:-5] for n in names if re.fullmatch(r"j_[0-9a-f]{12}\.json", n)]

    def remove(self, job_id: str) -> None:
        for folder in ("jobs", "results"):
            self._fs.delete(self._path(f"{self.root}/{folder}/{self._checked(job_id)}.json"), False)
        for found in self._fs.globStatus(self._path(f"{self.root}/events/{job_id}-*")) or []:
            self._fs.delete(found.getPath(), False)

    def jobs(self) -> DataFrame:
        return read_jobs(self.spark, f"{self.root}/jobs") if self.ids() else self.spark.createDataFrame([], schemas.JOBS)

    def events(self) -> DataFrame:
        there = self._fs.exists(self._path(f"{self.root}/events"))
        return read_events(self.spark, f"{self.root}/events") if there else self.spark.createDataFrame([], schemas.JOB_EVENTS)


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, datetime) else str(value)
