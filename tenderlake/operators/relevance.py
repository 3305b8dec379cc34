"""The most relevant notices for each past contract: a join on either side's codes that makes no pairs beyond the best ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.columns import value_ratio
from tenderlake.operators.relational import top_k
from tenderlake.operators.scale import ordered_counts

# Points for the same code, the same agency and like values, and for how long ago the work ended, in years.
CODE, AGENCY, VALUE = 35.0, 25.0, 20.0
RECENT = ((3, 20.0), (5, 10.0))


def recency(years: Column) -> Column:
    out = F.lit(0.0)
    for most, points in reversed(RECENT):
        out = F.when(years <= most, points).otherwise(out)
    return F.when(years.isNull(), 0.0).otherwise(out)


def places(notices: DataFrame, asked: DataFrame, by: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The notices of each class with their places by value, ``up`` (ties by key) and ``down`` (ties by key, greatest first), and ``asked`` with ``pos``, how many notices are not over its value."""
    rows = notices.select(*by, "value", F.lit(1).alias("w")).unionByName(asked.select(*by, "value", F.lit(0).alias("w")))
    told = ordered_counts(rows.where("value is not null"), by, "value", "w").select(*by, "value", "below", "n")
    joined = notices.join(told, [*by, "value"])
    tie = Window.partitionBy(*by, "value")
    ranked = joined.withColumn("up", F.col("below") + F.row_number().over(tie.orderBy(F.asc(key)))).withColumn("down", F.col("below") + F.row_number().over(tie.orderBy(F.desc(key))))
    return ranked, asked.join(told, [*by, "value"]).withColumn("pos", F.col("below") + F.col("n"))


def nearest(notices: DataFrame, asked: DataFrame, by: list[str], key: str, ask: str, k: int) -> DataFrame:
    """``(ask, key)``: of each class the ``k`` notices next below a value and the ``k`` next above it, by equi-joins on places."""
    ranked, at = places(notices, asked, by, key)
    span = lambda first, last: F.explode(F.sequence(first, last))
    below = at.where("pos > 0").select(ask, *by, span(F.greatest(F.col("pos") - k + 1, F.lit(1)), F.col("pos")).alias("down")).join(ranked.select(*by, "down", key), [*by, "down"])
    above = at.select(ask, *by, span(F.col("pos") + 1, F.col("pos") + k).alias("up")).join(ranked.select(*by, "up", key), [*by, "up"])
    return below.select(ask, key).unionByName(above.select(ask, key))


def most_relevant(past: DataFrame, notices: DataFrame, org_codes: DataFrame, k: int = 100) -> DataFrame:
    """``(past_id, notice_id, code_match, agency_match, value_similarity, score, rank)``: the ``k`` most relevant notices of each past contract.

    ``past``: past_id, org_id, code, agency, value, years; ``notices``:
    notice_id, code, agency, value; ``org_codes``: org_id, code. A notice is met
    through the contract's own code or any code of its organisation. Points
    are for the same code, the same agency, how alike the values are (smaller
    by greater) and how recent the work is. Of the notices of a code, one with
    ``k`` others of the same agency at least as alike in value is nobody's
    best, so for every code only the ``k`` next values on both sides are
    joined, once among all agencies and once among the contract's own. Without a value on a side
    nothing is alike: those notices are taken by least id. Ties go to the least notice.
    """
    codes = past.select("past_id", "code").unionByName(past.join(org_codes.withColumnRenamed("code", "_c"), "org_id").select("past_id", F.col("_c").alias("code"))).where("code is not null").distinct()
    asked = codes.join(past.select("past_id", "agency", F.when(F.col("value") > 0, F.col("value")).alias("value")), "past_id")
    priced = notices.where("value > 0").select("notice_id", "code", "agency", "value")
    met = [nearest(priced, asked.where("value is not null"), ["code"], "notice_id", "past_id", k), nearest(priced.where("agency is not null"), asked.where("value is not null and agency is not null"), ["code", "agency"], "notice_id", "past_id", k)]
    free = notices.where("not coalesce(value > 0, false)").select("notice_id", "code", "agency")
    plain = notices.select("notice_id", "code", "agency")
    for rows, who in ((free, asked), (plain, asked.where("value is null"))):
        first = top_k(rows.where("code is not null"), ["code"], [F.asc("notice_id")], k).select("code", "notice_id")
        own = top_k(rows.where("code is not null and agency is not null"), ["code", "agency"], [F.asc("notice_id")], k).select("code", "agency", "notice_id")
        met += [who.join(first, "code").select("past_id", "notice_id"), who.join(own, ["code", "agency"]).select("past_id", "notice_id")]
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    p = past.select("past_id", F.col("code").alias("p_code"), F.col("agency").alias("p_agency"), F.col("value").alias("p_value"), "years")
    rows = pairs.distinct().join(p, "past_id").join(notices, "notice_id")
    code, agency = F.coalesce(F.col("p_code") == F.col("code"), F.lit(False)), F.coalesce(F.col("p_agency") == F.col("agency"), F.lit(False))
    alike = value_ratio(F.col("p_value"), F.col("value"))
    score = F.when(code, CODE).otherwise(0.0) + F.when(agency, AGENCY).otherwise(0.0) + F.coalesce(alike, F.lit(0.0)) * VALUE + recency(F.col("years"))
    best = top_k(rows.withColumn("_score", score).withColumn("code_match", code).withColumn("agency_match", agency), ["past_id"], [F.desc("_score"), F.asc("notice_id")], k)
    return best.select("past_id", "notice_id", "code_match", "agency_match", F.round(alike, 2).alias("value_similarity"), F.round("_score", 1).alias("score"), "rank")
