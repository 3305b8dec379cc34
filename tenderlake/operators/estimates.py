"""Cost estimates by several methods and their ensemble, and the best notices for every organisation, for all requests at once."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tenderlake.functions.columns import bucket
from tenderlake.operators.relational import top_k
from tenderlake.operators.scale import quantiles

# The newest awards that are comparable, what each method is trusted, and the levels of mean trust.
COMPARABLE, YEARS, DAYS_A_MONTH = 500, 5, 30.0
ANALOG_TRUST = ((50, 0.8), (20, 0.6), (10, 0.4))
LABOR_TRUST, BURN_TRUST = 0.7, 0.5
LEVELS = ((0.7, "High"), (0.4, "Medium"))


def by_analog(requests: DataFrame, awards: DataFrame, key: str, code: str, value: str, start: str, order: Sequence[Column], now: Column) -> DataFrame:
    """``(key, method, estimate, confidence, n)``: the mean of the newest comparable awards of the request's code in the last five years, at most 500."""
    recent = awards.where((F.col(start) >= F.add_months(now, -12 * YEARS)) & (F.col(value) > 0) & F.col(code).isNotNull())
    mean = top_k(recent, [code], [F.desc(start), *order], COMPARABLE).groupBy(code).agg(F.round(F.avg(value), 2).alias("estimate"), F.count(F.lit(1)).alias("n"))
    trust = reduce(lambda w, s: w.when(F.col("n") >= s[0], s[1]), ANALOG_TRUST, F.when(F.lit(False), 0.0)).otherwise(0.2)
    return requests.join(mean, code).select(key, F.lit("analog").alias("method"), "estimate", trust.alias("confidence"), "n")


def by_labor(requests: DataFrame, mix: DataFrame, rates: DataFrame, key: str, category: str, hours: str, rate: str, months: str) -> DataFrame:
    """Median rate of each category times its hours, which are those of a year; categories without rates add nothing, a request without any has no estimate."""
    median = quantiles(rates.where(F.col(rate) > 0), [category], rate, [0.5]).select(category, F.col("q0").alias("_median"), F.col("n").alias("_n"))
    sums = mix.join(median, category).groupBy(key).agg(F.sum(F.col("_median") * F.col(hours)).alias("_sum"), F.sum("_n").alias("n"))
    scale = F.when(F.col(months) > 0, F.col(months) / 12.0).otherwise(1.0)
    return requests.join(sums, key).select(key, F.lit("labor").alias("method"), F.round(F.col("_sum") * scale, 2).alias("estimate"), F.lit(LABOR_TRUST).alias("confidence"), "n")


def by_burn_rate(requests: DataFrame, awards: DataFrame, key: str, solicitation: str, value: str, start: str, order: Sequence[Column], months: str, now: Column) -> DataFrame:
    """What the latest award of the request's solicitation has cost a month so far, for the months asked (12 by default)."""
    known = awards.where(F.col(value).isNotNull() & F.col(start).isNotNull() & F.col(solicitation).isNotNull())
    last = top_k(known, [solicitation], [F.desc(start), *order], 1).select(solicitation, F.col(value).alias("_value"), (F.datediff(now, F.col(start)) / DAYS_A_MONTH).alias("_months"))
    rows = requests.join(last.where("_months > 0"), solicitation)
    estimate = F.round(F.col("_value") / F.col("_months") * F.coalesce(F.col(months), F.lit(12)), 2)
    return rows.select(key, F.lit("burn").alias("method"), estimate.alias("estimate"), F.lit(BURN_TRUST).alias("confidence"), F.lit(1).cast("long").alias("n"))


def ensemble(requests: DataFrame, methods: Sequence[DataFrame], key: str) -> DataFrame:
    """``(key, estimate, n_methods, confidence, level)``: the methods' estimates weighted by their confidence; level ``None`` where none has one."""
    rows = reduce(DataFrame.unionByName, methods)
    sums = rows.groupBy(key).agg((F.sum(F.col("estimate") * F.col("confidence")) / F.sum("confidence")).alias("_e"), F.avg("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"))
    level = F.coalesce(bucket(F.round("_c", 6), LEVELS, "Low"), F.lit("None"))
    return requests.select(key).join(sums, key, "left").select(key, F.round("_e", 2).alias("estimate"), F.coalesce("_n", F.lit(0)).alias("n_methods"), F.round(F.when(F.col("_c") > 1, 1.0).otherwise(F.col("_c")), 2).alias("confidence"), level.alias("level"))


def candidate_codes(parts: Sequence[DataFrame], key: str, code: str) -> DataFrame:
    """``(key, code, standing)``: the codes of each organisation from several sources; a code counts for the first source that has it (0 is the first)."""
    tagged = [p.select(key, code, F.lit(i).alias("standing")) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged).where(F.col(code).isNotNull()).groupBy(key, code).agg(F.min("standing").alias("standing"))


def newest_of(notices: DataFrame, group: str, key: str, posted: str) -> DataFrame:
    """One notice a solicitation, the newest; a notice without one stands for itself."""
    solicitation = F.when(F.col(group) != "", F.col(group))
    mark = F.coalesce(F.concat(F.lit("s"), solicitation), F.concat(F.lit("n"), F.col(key).cast("string")))
    return top_k(notices.withColumn("_mark", mark), ["_mark"], [F.desc(posted), F.desc(key)], 1).drop("_mark", "rank")


def climb(df: DataFrame, by: Sequence[str], value: str, notice: str, k: int) -> DataFrame:
    """The rows of ``df`` that are ever among the ``k`` best of their group (by ``_fixed``, then the least notice) as the group is gone through by rising value, nulls last, with ``_to`` and ``_top``.

    ``_to`` is the value of the row that put one out, and ``_top`` tells those
    that are left at the end, the best of the whole group. Ranges of a group
    are thinned out first, so that a group's last pass holds few of its rows.
    """
    fields = df.schema.fieldNames()

    def rows(last: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, best = None, []
            rank = lambda r: (r["_fixed"] is None, -(r["_fixed"] or 0), r[notice])
            told = lambda r, to, top: {**r, "_to": to, "_top": top} if last else r
            schema = None
            for batch in batches:
                schema = schema or (batch.schema.append(pa.field("_to", batch.schema.field(value).type)).append(pa.field("_top", pa.bool_())) if last else batch.schema)
                out = []
                for r in batch.to_pylist():
                    group = [r[x] for x in by]
                    if group != at:
                        out += [told(b, None, True) for b in best]
                        at, best = group, []
                    insort(best, r, key=rank)
                    if len(best) > k and (gone := best.pop()) is not r:
                        out.append(told(gone, r[value], False))
                yield pa.RecordBatch.from_pylist(out, schema)
            if best:
                yield pa.RecordBatch.from_pylist([told(b, None, True) for b in best], schema)

        return go

    order = [*by, F.asc_nulls_last(value)]
    few = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(rows(False), df.schema)
    full = StructType([*df.schema.fields, StructField("_to", df.schema[value].dataType), StructField("_top", BooleanType())])
    return few.select(*fields).repartition(*by).sortWithinPartitions(*order).mapInArrow(rows(True), full)


def recommend(codes: DataFrame, notices: DataFrame, certs: DataFrame, org: str, code: str, notice: str, required: str, k: int, fixed: Column, varying: Column, least: float, most: float, below: tuple[str, str] | None = None) -> DataFrame:
    """``(org, notice, score, rank)``: the ``k`` best notices of each organisation among those of its codes, of which it has the required certificate.

    ``score`` is ``fixed``, of the notice's columns alone, plus ``varying``, of
    both sides, which lies between ``least`` and ``most``. Within the notices of
    one code and requirement, whoever has ``k`` others over it by more than
    ``most - least`` in ``fixed`` is among nobody's best, so it is left out
    before the join. Nothing else is: ties are settled by the least notice.

    If ``varying`` takes from the notice only whether its first column of
    ``below`` is less than the organisation's second one, and is no less where
    it is, an organisation's best of a code and requirement are among the
    ``k`` best in ``fixed`` and the ``k`` best of those that are less: no other
    pair is made, however many notices a code has.
    """
    scored = notices.where(F.col(code).isNotNull()).withColumn("_fixed", fixed)
    if below:
        kept = climb(scored, [code, required], below[0], notice, k).withColumnRenamed(code, "_code")
        less = F.col(below[0]) < F.col(below[1])
        able = F.col("_top") | (less & (F.col("_to").isNull() | (F.col(below[1]) <= F.col("_to"))))
    else:
        kth = top_k(scored, [code, required], [F.desc("_fixed"), F.asc(notice)], k).groupBy(F.col(code).alias("_code"), F.col(required).alias("_req")).agg(F.min("_fixed").alias("_kth"), F.count(F.lit(1)).alias("_n"))
        kept = scored.join(kth, (F.col(code) == F.col("_code")) & F.col(required).eqNullSafe(F.col("_req"))).where((F.col("_n") < k) | (F.col("_fixed") + most >= F.col("_kth") + least)).drop(code, "_req", "_kth", "_n")
        able = F.lit(True)
    held = certs.groupBy(F.col(org).alias("_org")).agg(F.collect_set(certs.columns[1]).alias("_certs"))
    none = F.array(F.lit(None).cast(held.schema["_certs"].dataType.elementType))
    wants = codes.join(held, F.col(org) == F.col("_org"), "left").withColumn("_cert", F.explode(F.concat(none, F.coalesce("_certs", F.array())))).drop("_certs")
    met = wants.join(kept, (F.col(code) == F.col("_code")) & F.col("_cert").eqNullSafe(F.col(required)) & able)
    return top_k(met.select(org, notice, (F.col("_fixed") + varying).alias("score")), [org], [F.desc("score"), F.asc(notice)], k)
