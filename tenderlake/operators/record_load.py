"""A load of records as sets: classified against the table and against each other, with history, children, errors and counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.columns import record_hash
from tenderlake.operators.scale import cut


class Loaded(NamedTuple):
    """``table`` and ``children`` after the load, ``history`` of changed fields, ``errors``, and ``counts`` of one row."""

    table: DataFrame
    history: DataFrame
    errors: DataFrame
    counts: DataFrame
    children: dict[str, DataFrame]


class Children(NamedTuple):
    """A child table, and its rows as the incoming records bring them: with the parent's keys and the record's ``order``."""

    table: DataFrame
    fresh: DataFrame


def filled(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "") for k in keys])


def load_records(table: DataFrame, incoming: DataFrame, keys: Sequence[str], hash_columns: Sequence[str], order: str, load_id: str, children: Mapping[str, Children] = {}) -> Loaded:
    """What loading ``incoming`` record by record, in ``order``, leaves behind.

    A record whose hash is that of the one before it with its keys, or of the
    table's row, changes nothing. Each other one is an insert or an update; an
    update leaves a row of history for each changed field, between two versions
    of the same load too. The table keeps the last version that changed
    something, and the children of its keys are replaced by those that this
    version brings. Records without a key are errors and change nothing. Of the
    table only rows of incoming keys are hashed. ``incoming`` has the table's
    columns and ``order``, which is unique for a key.
    """
    columns, keys = table.columns, list(keys)
    errors = incoming.where(~filled(keys)).select(F.lit(load_id).alias("load_id"), F.col(order), F.lit("MissingKey").alias("error_type"), F.to_json(F.struct(*[F.col(c) for c in columns])).alias("raw_data"))
    valid = incoming.where(filled(keys)).withColumn("_hash", record_hash(hash_columns))
    wanted = table.join(valid.select(*keys).distinct(), keys, "left_semi").select(*keys, record_hash(hash_columns).alias("_old"), F.struct(*hash_columns).alias("_row"))
    by = Window.partitionBy(*keys).orderBy(order)
    rows = valid.withColumn("_before", F.lag("_hash").over(by)).withColumn("_was", F.lag(F.struct(*hash_columns)).over(by)).join(wanted, keys, "left")
    rows = rows.withColumn("_before", F.coalesce("_before", "_old")).withColumn("_was", F.coalesce("_was", "_row"))
    outcome = F.when(F.col("_before").isNull(), "inserted").when(F.col("_before") != F.col("_hash"), "updated").otherwise("unchanged")
    rows = cut(rows.withColumn("outcome", outcome).select(*columns, *([order] if order not in columns else []), "_was", "outcome"))
    fields = [F.struct(F.lit(c).alias("field"), F.col("_was")[c].cast("string").alias("old_value"), F.col(c).cast("string").alias("new_value")) for c in hash_columns]
    history = rows.where("outcome = 'updated'").select(F.lit(load_id).alias("load_id"), *keys, order, F.inline(F.array(*fields))).where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    last = rows.where("outcome != 'unchanged'").groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r"), F.max(order).alias("_at"))
    fresh = last.select(*[F.col("_r")[c].alias(c) for c in columns])
    after = table.join(last.select(*keys), keys, "left_anti").unionByName(fresh)
    counts = rows.agg(F.count(F.lit(1)).alias("_valid"), *[F.count_if(F.col("outcome") == x).alias(f"records_{x}") for x in ("inserted", "updated", "unchanged")])
    counts = counts.join(F.broadcast(errors.agg(F.count(F.lit(1)).alias("records_errored"))))  # one row each
    counts = counts.select((F.col("_valid") + F.col("records_errored")).alias("records_read"), "records_inserted", "records_updated", "records_unchanged", "records_errored")
    synced = {}
    for name, child in children.items():
        new = child.fresh.join(last.select(*keys, F.col("_at").alias(order)), [*keys, order], "left_semi").select(*child.table.columns)
        synced[name] = child.table.join(last.select(*keys), keys, "left_anti").unionByName(new)
    return Loaded(after, history, errors, counts, synced)


def full_refresh(fresh: DataFrame, path: str, least: int = 1) -> int:
    """``path`` holds either what it held or all of ``fresh``: written beside it, counted, then swapped in; fewer than ``least`` rows are an error and change nothing."""
    spark = fresh.sparkSession
    beside, old = f"{path}.next", f"{path}.old"
    fresh.write.mode("overwrite").parquet(beside)
    n = spark.read.parquet(beside).count()
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if n < least:
        fs.delete(at(beside), True)
        raise ValueError(f"{n} rows; at least {least} make a full refresh")
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(beside), at(path))
    fs.delete(at(old), True)
    return n


def recover_refresh(spark, path: str) -> None:
    """After a refresh that was killed: between the two renames the old table is at ``.old``, and goes back."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.old")):
        fs.rename(at(f"{path}.old"), at(path))
