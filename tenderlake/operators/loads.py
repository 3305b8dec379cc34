"""Loads that can be killed and run again: an append-only log of events, its states and watermarks, and batches of files that are written once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "load_id string, source string, load_type string, status string, at timestamp, parameters string, records_read long, records_written long, message string"
# Fixed values.
STALE_HOURS = 2
STALE_MESSAGE = "Stale RUNNING load cleaned up (>2 hours)"


def load_states(events: DataFrame) -> DataFrame:
    """One row a load: when it started, and status, parameters, counts and message of its last event; equal times go to the further status."""
    order = F.struct("at", F.when(F.col("status") == "RUNNING", 0).otherwise(1), "status")
    last = F.max_by(F.struct("status", "parameters", "records_read", "records_written", "message", F.col("at").alias("updated_at")), order)
    out = events.groupBy("load_id", "source").agg(F.min("at").alias("started_at"), F.max_by("load_type", "at").alias("load_type"), last.alias("_l"))
    return out.select("load_id", "source", "load_type", "started_at", "_l.*")


def complete_flag(parameters: Column) -> Column:
    """``complete`` of the parameters as true, false or null: null is a load from before there was the flag."""
    return F.get_json_object(parameters, "$.complete").cast("boolean")


def watermarks(states: DataFrame, date_key: str = "date_to") -> DataFrame:
    """``(source, watermark)``: the date of each source's last load that is whole; a load without the flag counts as whole, one with ``false`` doesn't."""
    date = F.get_json_object("parameters", f"$.{date_key}")
    whole = states.where((F.col("status") == "SUCCESS") & F.coalesce(complete_flag(F.col("parameters")), F.lit(True)) & date.isNotNull())
    return whole.groupBy("source").agg(F.max_by(date, F.struct("started_at", "load_id")).alias("watermark"))


def resumable(states: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Each source's last load that saved its progress and says that it isn't whole, for the same dates; without a first date only loads without one."""
    value = lambda k: F.get_json_object("parameters", f"$.{k}")
    open_ = states.where((F.col("status") == "SUCCESS") & (complete_flag(F.col("parameters")) == F.lit(False)))
    open_ = open_.where(value("date_from").isNull() if date_from is None else value("date_from") == date_from)
    open_ = open_ if date_to is None else open_.where(value("date_to") == date_to)
    return open_.groupBy("source").agg(F.max_by(F.struct(*[c for c in states.columns if c != "source"]), F.struct("started_at", "load_id")).alias("_l")).select("source", "_l.*")


def stale(states: DataFrame, now: str | Column, hours: int = STALE_HOURS) -> DataFrame:
    """Events that end as FAILED what is RUNNING for longer than ``hours``."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    old = states.where((F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr(f"interval {hours} hours")))
    return old.select("load_id", "source", "load_type", F.lit("FAILED").alias("status"), now.alias("at"), "parameters", "records_read", "records_written", F.lit(STALE_MESSAGE).alias("message"))


class LoadLog:
    """The log in a folder that all see. Events are only appended, so a killed writer leaves no half state; the state is the last event."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENT).parquet(self.path)
        except Exception as e:  # the folder isn't there before the first event
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], EVENT)

    def states(self) -> DataFrame:
        return load_states(self.events())

    def add(self, events: DataFrame) -> None:
        events.select(*[c.split()[0] for c in EVENT.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)

    def _event(self, load_id: str, source: str, load_type: str, status: str, at: str, parameters: Mapping | None = None, read: int = 0, written: int = 0, message: str | None = None) -> None:
        row = (load_id, source, load_type, status, at, json.dumps(parameters) if parameters else None, read, written, message)
        self.add(self.spark.createDataFrame([row], EVENT.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp")))

    def start(self, source: str, load_type: str, at: str, parameters: Mapping | None = None) -> str:
        load_id = uuid.uuid4().hex
        self._event(load_id, source, load_type, "RUNNING", at, parameters)
        return load_id

    def progress(self, load_id: str, source: str, load_type: str, at: str, parameters: Mapping, read: int = 0, written: int = 0) -> None:
        """What is done so far; ``complete`` in the parameters says whether that is all."""
        self._event(load_id, source, load_type, "SUCCESS", at, parameters, read, written)

    def fail(self, load_id: str, source: str, load_type: str, at: str, message: object) -> None:
        self._event(load_id, source, load_type, "FAILED", at, message=str(message)[:5000])

    def expire(self, now: str) -> int:
        gone = stale(self.states(), now)
        n = gone.count()
        if n:
            self.add(self.spark.createDataFrame(gone.collect(), gone.schema))  # rows of the log itself, read before it is appended to
        return n


def file_marks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, mark)``: a digest of name, length and content for each file; executors read the files, only digests leave them."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("file"), F.sha2(F.concat_ws("|", name, F.col("length"), F.sha2("content", 256)), 256).alias("mark"))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose mark isn't done yet; of files of one mark the first by name."""
    return files.join(done.select("mark").distinct(), "mark", "left_anti").groupBy("mark").agg(F.min("file").alias("file"))


def load_files(spark: SparkSession, source: str, folder: str, target: str, log: LoadLog, read: Callable[[SparkSession, Sequence[str]], DataFrame], now: str, files_per_batch: int = 64) -> dict:
    """Every file of ``folder`` once into ``target``, however often this is killed and run again.

    A batch is a number of files, named by a digest of their marks; it
    overwrites its own folder ``target/batch=..`` and only then is its mark
    logged. Killed in between, the next run writes that batch anew, if the same
    files make it, and first deletes folders of batches that were never logged. Files that are logged are skipped by
    mark, also under another name. The list of pending files, not their
    content, comes to the driver.
    """
    log.expire(now)
    logged = log.states().where((F.col("source") == source) & (F.col("status") == "SUCCESS") & (F.get_json_object("parameters", "$.batch").isNotNull()))
    done = logged.select(F.explode(F.from_json(F.get_json_object("parameters", "$.marks"), "array<string>")).alias("mark"))
    todo = [(r.mark, r.file) for r in pending(file_marks(spark, folder), done).orderBy("file").toLocalIterator()]
    _drop_unlogged(spark, target, {r[0] for r in logged.select(F.get_json_object("parameters", "$.batch")).collect()})
    written = batches = 0
    for i in range(0, len(todo), files_per_batch):
        part = todo[i : i + files_per_batch]
        marks = [m for m, _ in part]
        batch = uuid.uuid5(uuid.NAMESPACE_URL, "|".join(marks)).hex
        load_id = log.start(source, "FILES", now, {"batch": batch, "complete": False})
        rows = read(spark, [f for _, f in part])
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        n = spark.read.parquet(f"{target}/batch={batch}").count()
        log.progress(load_id, source, "FILES", now, {"batch": batch, "marks": marks, "complete": True}, n, n)
        written, batches = written + n, batches + 1
    return {"files": len(todo), "batches": batches, "written": written}


def _drop_unlogged(spark: SparkSession, target: str, logged: set[str]) -> None:
    """Folders of batches that were written but never logged: what is in them comes again."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("batch=") and name[6:] not in logged:
                fs.delete(status.getPath(), True)
