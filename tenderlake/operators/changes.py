"""Change detection and keyed merges: hashes decide, joins merge, nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenderlake.functions.columns import record_hash


def classify(base: DataFrame, incoming: DataFrame, keys: Sequence[str], hash_columns: Sequence[str]) -> DataFrame:
    """``incoming`` with ``action``: insert, update or unchanged; only keys and hashes of the base are shuffled."""
    old = base.select(*keys, record_hash(hash_columns).alias("_old"))
    joined = incoming.withColumn("_new", record_hash(hash_columns)).join(old, list(keys), "left")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_old") != F.col("_new"), "update").otherwise("unchanged")
    return joined.withColumn("action", action).drop("_old", "_new")


def field_diff(base: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each changed field: key, field, old_value, new_value as text; nulls compare as values."""
    old = base.select(*keys, *[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    fields = [F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("old_value"), F.col(c).cast("string").alias("new_value")) for c in columns]
    rows = incoming.join(old, list(keys)).select(*keys, F.inline(F.array(*fields)))
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def merge_upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace base rows of the same key; keys must be unique on either side."""
    return base.join(incoming, list(keys), "left_anti").unionByName(incoming)


def insert_ignore(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.unionByName(incoming.join(base, list(keys), "left_anti"))


def apply_delta(base: DataFrame, delta: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Upsert, with rows whose ``flag`` is D kept and marked ``deleted`` instead."""
    marks = delta.select(*keys, (F.col(flag) == "D").alias("_gone"))
    kept = base.join(marks, list(keys), "left").where("_gone is null or _gone").withColumn("deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")
    fresh = delta.where(F.col(flag) != "D").drop(flag).withColumn("deleted", F.lit(False))
    return kept.unionByName(fresh)


def quality_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that fail each rule (a SQL condition that valid rows meet; unknown counts as failed), in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(cond), F.lit(False))).alias(name) for name, cond in rules.items()])
    return counts.unpivot([], list(rules), "rule", "failed")


def hash_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, canonical, is_canonical)``: rows of equal content point to the least id; the hash is all that is shuffled."""
    hashed = df.select(id_col, F.coalesce(F.sha2(text_col, 256), F.lit("")).alias("_h"))  # rows without text are equal
    first = hashed.groupBy("_h").agg(F.min(id_col).alias("canonical"))
    return hashed.join(first, "_h").select(id_col, "canonical", (F.col(id_col) == F.col("canonical")).alias("is_canonical"))


def weighted_score(factors: Sequence[tuple[str, float]], places: int = 2):
    """Sum of score * weight over the factors that have data, divided by the weight of those; null if none has."""
    have = [(F.col(c), F.col(c).isNotNull().cast("double") * w, w) for c, w in factors]
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, _, w in have])
    weight = reduce(lambda a, b: a + b, [w for _, w, _ in have])
    return F.when(weight > 0, F.round(total / weight, places))


def child_sync(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``fresh`` are replaced by its rows; others stay."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def retain(df: DataFrame, at: str, days: int, as_of: str) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``, and those without a date."""
    return df.where(F.col(at).isNull() | (F.col(at) >= F.date_sub(F.lit(as_of).cast("date"), days)))


def current_flag(df: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """``is_current``: whether the row has its key's last revision; revisions are aggregated, then joined back."""
    last = df.groupBy(*keys).agg(F.max(revision).alias("_last"))
    return df.join(last, list(keys)).withColumn("is_current", F.col(revision).eqNullSafe(F.col("_last"))).drop("_last")


def enrich_missing(df: DataFrame, detail: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` filled from ``detail`` (one row a key) where they are null."""
    more = detail.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}
    return df.join(more, list(keys), "left").select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def schema_drift(spark: SparkSession, expected: StructType, actual: StructType) -> DataFrame:
    """``(column_name, expected, actual, drift)`` where two schemas differ: missing, extra or type."""
    want, have = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (expected, actual))
    drift = lambda c: "missing" if c not in have else "extra" if c not in want else "type"
    rows = [(c, want.get(c), have.get(c), drift(c)) for c in sorted({*want, *have}) if want.get(c) != have.get(c)]
    return spark.createDataFrame(rows, "column_name string, expected string, actual string, drift string")


def freshness(last_runs: DataFrame, limits: DataFrame, source: str, at: str, as_of: str) -> DataFrame:
    """Each source of ``limits`` (source, hours) with its age and OK, WARNING from 80 % of its hours on, STALE beyond them, NEVER without a run."""
    last = last_runs.groupBy(source).agg(F.max(at).alias("_at"))
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("_at")) / 3600.0
    status = F.when(F.col("age_hours").isNull(), "NEVER").when(F.col("age_hours") > F.col("hours"), "STALE").when(F.col("age_hours") > 0.8 * F.col("hours"), "WARNING").otherwise("OK")
    return limits.join(last, source, "left").withColumn("age_hours", age).withColumn("status", status).drop("_at")


def refresh_rows(table: DataFrame, changed: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of ``changed`` keys replaced by those of ``fresh``; a changed key without a fresh row is gone. The rest is not computed again."""
    return table.join(changed.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)
