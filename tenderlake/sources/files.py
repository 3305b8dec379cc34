"""Scans of delimited extracts, CSV with renamed columns, nested JSON, and windows of dates for paged loads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions.columns import flagged_codes


def scan_extract(spark: SparkSession, path: str, columns: Sequence[str], key: str, first_row: bool = False) -> DataFrame:
    """Pipe-delimited lines between BOF and EOF marks: ``|\\`` escapes mended, short rows and rows without a key dropped.

    Rows of one key are merged: for each column the first value that isn't
    empty, in line order of the file, or with ``first_row`` the first row as it is.
    """
    lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("_n"))
    body = lines.where(~F.col("value").rlike("^(BOF|EOF)\\b")).withColumn("value", F.regexp_replace("value", r"\|\\\|", "||"))
    parts = body.select("_n", F.split("value", r"\|", -1).alias("p")).where(F.size("p") >= len(columns))
    rows = parts.select("_n", *[F.when(F.trim(F.col("p")[i]) != "", F.trim(F.col("p")[i])).alias(c) for i, c in enumerate(columns)]).where(F.col(key).isNotNull())
    if first_row:
        others = [c for c in columns if c != key]
        return rows.groupBy(key).agg(F.min_by(F.struct(*others), "_n").alias("_first")).select(*[F.col(c) if c == key else F.col("_first")[c].alias(c) for c in columns])
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in columns if c != key]
    return rows.groupBy(key).agg(*first).select(*columns)


def extract_count(spark: SparkSession, path: str) -> DataFrame:
    """``(declared)``: the record count in the BOF line."""
    head = spark.read.text(path).where(F.col("value").rlike("^BOF\\b"))
    return head.select(F.regexp_extract("value", r"(\d+)\s*$", 1).cast("long").alias("declared"))


def scan_csv(spark: SparkSession, path: str, rename: Mapping[str, str], types: Mapping[str, str] = {}, multi_line: bool = True) -> DataFrame:
    """Columns by header name, renamed and cast; values that don't fit their type become null. A byte-order mark is dropped.

    Where no value has a line break, ``multi_line=False`` lets Spark split large files over many tasks.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.select(*[F.col(f"`{old}`").try_cast(types.get(new, "string")).alias(new) for old, new in rename.items()])


def scan_json(spark: SparkSession, path: str, schema: str, list_path: str, fields: Mapping[str, str]) -> DataFrame:
    """A row for each element of the list at ``list_path``; ``fields`` maps a name to a path within an element."""
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.explode(list_path).alias("_e")).select(*[F.col(f"_e.{at}").alias(name) for name, at in fields.items()])


def date_windows(spark: SparkSession, start: str, end: str, days: int = 365) -> DataFrame:
    """``(first_day, last_day)``: the span cut into windows of at most ``days`` days."""
    spans = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {days} days)")).alias("first_day"))
    return spans.withColumn("last_day", F.least(F.date_add("first_day", days - 1), F.lit(end).cast("date")))


def child_rows(parents: DataFrame, key: str, column: str, separator: str = "~") -> DataFrame:
    """``(key, code, flag)``: a row for each part of a separated list, its last character split off as the flag if it is Y or N."""
    return parents.select(key, F.inline(flagged_codes(F.col(column), separator)))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, split, line)``: lines whose order in a file is that of ``split`` and ``line``, however the file is cut over tasks."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def number_runs(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``file``, ``split`` and ``line``) and ``run``: consecutive rows of a file with the same key have the same one.

    Runs are counted within each split; a table of one row a split tells
    whether its first run goes on from the split before, over as many splits as it spans.
    """
    here = Window.partitionBy("file", "split").orderBy("line")
    fresh = F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(here))).cast("int"), F.lit(1))
    first = F.row_number().over(here) == 1
    rows = rows.withColumn("_fresh", F.when(first, 1).otherwise(fresh)).withColumn("_run", F.sum("_fresh").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    splits = rows.groupBy("file", "split").agg(F.min_by(F.struct(key), "line").alias("_first"), F.max_by(F.struct(key), "line").alias("_last"), F.max("_run").alias("_runs"))
    order = Window.partitionBy("file").orderBy("split")
    goes_on = F.coalesce(F.lag("_last").over(order).eqNullSafe(F.col("_first")), F.lit(False)) & F.lag("_last").over(order).isNotNull()
    splits = splits.withColumn("_on", goes_on)
    own = F.when((F.col("_runs") > 1) | ~F.col("_on"), F.struct("split", F.col("_runs").alias("run")))
    splits = splits.withColumn("_ends", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    splits = splits.withColumn("_from", F.when(F.col("_on"), F.lag("_ends").over(order))).select(F.col("file").alias("_f"), F.col("split").alias("_s"), "_from")
    joined = rows.join(splits, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    run = F.when((F.col("_run") == 1) & F.col("_from").isNotNull(), F.col("_from")).otherwise(F.struct("split", F.col("_run").alias("run")))
    return joined.withColumn("run", run).drop("_fresh", "_run", "_f", "_s", "_from")


def scan_extract_runs(spark: SparkSession, path: str, columns: Sequence[str], key: str, collect: Sequence[str] = ()) -> DataFrame:
    """As :func:`scan_extract`, but only neighbouring rows of one key are one record: its first row, and ``more_<column>`` with what the rows after it have in ``collect``.

    A key that comes again further down is a record of its own.
    """
    body = ordered_lines(spark, path).where(~F.col("value").rlike("^(BOF|EOF)\\b")).withColumn("value", F.regexp_replace("value", r"\|\\\|", "||"))
    parts = body.withColumn("p", F.split("value", r"\|", -1)).where(F.size("p") >= len(columns))
    rows = parts.select("file", "split", "line", *[F.when(F.trim(F.col("p")[i]) != "", F.trim(F.col("p")[i])).alias(c) for i, c in enumerate(columns)]).where(F.col(key).isNotNull())
    at = F.struct("split", "line")
    record = number_runs(rows, key).groupBy("file", "run").agg(
        F.min(at).alias("_at"), F.min_by(F.struct(*columns), at).alias("_r"), *[F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))).alias(f"_{c}") for c in collect]
    )
    more = [F.transform(F.filter(f"_{c}", lambda x: x["at"] > F.col("_at")), lambda x: x["v"]).alias(f"more_{c}") for c in collect]
    return record.select(*[F.col("_r")[c].alias(c) for c in columns], *more)
