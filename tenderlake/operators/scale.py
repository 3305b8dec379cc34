"""Order over whole tables without a task that holds a table or a group: exact running counts, quantiles and ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the folder in ``spark.checkpoint.dir`` and read back: short lineage, and fixed rows for passes that must see the same ones.

    Where that is unset a temporary folder is used, but only on a local master.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(base or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    """Null-safe equality of the keys of ``a`` with those of ``b``, which have ``_k_`` before their names."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_k_{k}"])
    return out


def ordered_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``(by, value, n, below, known)``: for each distinct value of a group its rows, the rows of lesser values, and all rows with a value.

    With a ``weight`` rows count as much as it says, 0 included.

    Rows are first counted by value, where they are. The counts are dealt by
    ranges of group and value, so that a large group spans tasks; each range
    tells its sum by group, and the sums of the ranges before are added to the
    running sum within one. Nulls stand in a row of their own that counts for nobody.
    """
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*by, value).agg(counted.alias("n")).withColumn("_w", F.when(F.col(value).isNotNull(), F.col("n")).otherwise(F.lit(0)))
    ranged = cut(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    keys = [*by, "_range"]
    sizes = ranged.groupBy(*keys).agg(F.sum("_w").alias("_here"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_here").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], before.alias("_before"), F.sum("_here").over(group).alias("known"))
    upto = F.sum("_w").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("_upto", upto)
    out = out.join(sizes, same(out, sizes, keys))
    return out.select(*by, value, "n", (F.col("_before") + F.col("_upto") - F.col("_w")).alias("below"), "known")


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """``(by, q0, q1, .., n)``: exact quantiles with linear interpolation, one column a point; null where a group has no value."""
    counts = ordered_counts(df, by, value)
    has = F.when(F.col(value).isNotNull(), F.col("n")).otherwise(F.lit(0))
    aggregates = [F.coalesce(F.max("known"), F.lit(0)).alias("n")]
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("known") - 1)
        for name, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (F.col("below") <= place) & (place < F.col("below") + has)
            aggregates.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}{i}"))
    out = counts.groupBy(*by).agg(*aggregates)
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("n") - 1)
        between = (F.ceil(at) - at) * F.col(f"_low{i}") + (at - F.floor(at)) * F.col(f"_high{i}")
        out = out.withColumn(f"q{i}", F.when(F.ceil(at) == F.floor(at), F.col(f"_low{i}")).otherwise(between))
    return out.select(*by, *[f"q{i}" for i in range(len(points))], "n")


def share_greater(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``pct_greater``, the percent of all rows whose value is greater; a null is less than any value."""
    counts = ordered_counts(df, [], value)
    greater = F.when(F.col(value).isNull(), F.col("known")).otherwise(F.col("known") - F.col("below") - F.col("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    ranked = counts.withColumn("_greater", greater).join(F.broadcast(total))  # one row
    ranked = ranked.select(F.col(value).alias("_value"), F.round(100.0 * F.col("_greater") / F.col("_total"), 4).alias("pct_greater"))
    return df.join(ranked, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
