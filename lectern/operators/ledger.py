"""Texts sent to a service with a quota, each once: answers are kept in a ledger that later runs and retried tasks look into.

The ledger is a folder of JSON lines.  A worker adds a file of its own after every few answers, so what a lost task or a run
that was cut has asked is not asked again; a text is named by its digest, so copies of a text are one request.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "digest string, answer string, status string, requests int, day string, run string, part int"


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """All that was asked so far; a text that had no answer in one run may have one in another."""
    system, path = pafs.FileSystem.from_uri(ledger)
    system.create_dir(path, recursive=True)
    return spark.read.schema(ENTRY).json(ledger)


def answers(spark: SparkSession, ledger: str) -> DataFrame:
    """digest, answer: one for each text that has been answered, the least where a task that ran twice got two."""
    return entries(spark, ledger).where("status = 'success'").groupBy("digest").agg(F.min("answer").alias("answer"))


class _Worker:
    """One task's requests: its share of the rate and of the day, and the file of what it got."""

    def __init__(self, ledger: str, run: str, part: int, every: int, budget: int | None, gap: float, sleep, now):
        self.system, self.path = pafs.FileSystem.from_uri(ledger)
        self.run, self.part, self.every, self.gap, self.sleep, self.now = run, part, every, gap, sleep, now
        self.held, self.next, self.known = [], None, set()
        used = 0
        for f in self.system.get_file_info(pafs.FileSelector(self.path)):
            if f.base_name.startswith(f"{run}-{part}-"):  # of an earlier attempt of this task
                with self.system.open_input_stream(f.path) as s:
                    for line in s.read().decode().splitlines():
                        e = json.loads(line)
                        self.known.add(e["digest"])
                        used += e["requests"]
        self.left = None if budget is None else budget - used

    def may_ask(self) -> bool:
        """Whether the day has a request left; waits for the rate's next one."""
        if self.left is not None and self.left <= 0:
            return False
        if self.next is not None and self.next > self.now():
            self.sleep(self.next - self.now())
        self.next = self.now() + self.gap
        if self.left is not None:
            self.left -= 1
        return True

    def add(self, digest: str, answer: str | None, status: str, requests: int) -> None:
        day = datetime.fromtimestamp(self.now(), UTC).date().isoformat()
        self.held.append({"digest": digest, "answer": answer, "status": status, "requests": requests, "day": day, "run": self.run, "part": self.part})
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            name = f"{self.run}-{self.part}-{uuid.uuid4().hex[:12]}.json"
            with self.system.open_output_stream(f"{self.path}/_{name}") as f:  # readers pass over names with such a beginning
                f.write("".join(json.dumps(e) + "\n" for e in self.held).encode())
            self.system.move(f"{self.path}/_{name}", f"{self.path}/{name}")
            self.held = []


def ask(texts: DataFrame, load: Callable[[], Callable[[str], str]], ledger: str, per_minute: float | None = None, per_day: int | None = None, workers: int = 4, attempts: int = 3, least: float = 15.0, every: int = 1, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> dict[str, int]:
    """Ask for each distinct text of a string column `text` that the ledger has no answer of; returns how many had each status.

    `load` runs once a task and returns the service.  All workers together make at most `per_minute` requests a minute and
    `per_day` a day (UTC, with those of earlier runs): beyond that texts stay for a later run, with status deferred.  After
    refusal number n a worker waits `least` * n seconds, or what the refusal asks for ("retry in 7.5s") and one more.
    Answers are kept `every` so many; a lost worker can have asked fewer than that in vain.  Null and blank texts are not asked.
    """
    spark, run = texts.sparkSession, uuid.uuid4().hex[:12]
    today = datetime.fromtimestamp(now(), UTC).date().isoformat()
    left = None if per_day is None else max(0, per_day - (entries(spark, ledger).where(F.col("day") == today).agg(F.sum("requests")).first()[0] or 0))
    gap = 60.0 * workers / per_minute if per_minute else 0.0

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        worker = _Worker(ledger, run, part, every, None if left is None else left // workers + (part < left % workers), gap, sleep, now)
        service, done = None, []

        def one(text: str) -> tuple[str | None, str, int]:
            n = 0
            while n < attempts:
                if not worker.may_ask():
                    return None, "deferred", n
                n += 1
                try:
                    return service(text), "success", n
                except Exception as e:  # the service's own errors are not known here
                    asked = re.search(r"retry in (\d+\.?\d*)s", str(e))
                    if n < attempts:
                        sleep(max(least * n, float(asked[1]) + 1 if asked else 0.0))
            return None, "max_retries_exceeded", n

        try:
            for batch in batches:
                for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if digest in worker.known:
                        continue
                    service = service or load()
                    answer, status, n = one(text)
                    done.append(status)
                    if n:
                        worker.add(digest, answer, status, n)
        finally:
            worker.flush()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["status"])

    new = texts.select("text").where("trim(text) <> ''").distinct().select(F.sha2("text", 256).alias("digest"), "text")
    new = new.join(answers(spark, ledger).select("digest"), "digest", "left_anti").repartition(workers, "digest")
    return {r.status: r["count"] for r in new.mapInArrow(calls, "status string").groupBy("status").count().collect()}


def answered(rows: DataFrame, ledger: str, source: str, target: str) -> DataFrame:
    """rows with `target` and `status`: success, empty_input, or unanswered with the source's text."""
    known = answers(rows.sparkSession, ledger)
    out = rows.withColumn("__d", F.sha2(source, 256)).join(known.select(F.col("digest").alias("__d"), F.col("answer").alias("__a")), "__d", "left")
    blank = F.coalesce(F.trim(source), F.lit("")) == ""
    status = F.when(blank, "empty_input").when(F.col("__a").isNull(), "unanswered").otherwise("success")
    return out.withColumns({target: F.coalesce("__a", source), "status": status}).drop("__d", "__a")
