"""Names that mean the same: a similarity join that finds all pairs, matching against reference names, variants and resolution to codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def token_sort_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / summed length of the texts with words sorted; bit-parallel."""
    return sorted_ratio(*(" ".join(sorted(x.split())) for x in (a, b)))


def sorted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & at.get(ch, 0)
        s = (s + u | s - u) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def words_sorted(name: Column) -> Column:
    """The words of a name in order of their characters, one blank between them."""
    return F.array_join(F.array_sort(F.filter(F.split(name, r"\s+"), lambda w: w != "")), " ")


@F.pandas_udf(DoubleType())
def score_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sorted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_texts(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, score)``: all pairs of texts of the first columns with ``200 * LCS / (len + len) >= threshold``, and no other.

    Each text has the pairs of neighbouring characters of itself with a mark
    before and after it, the k-th of equal ones being another than the first.
    Leaving a character out destroys two of them, putting one in destroys one,
    so similar texts share all but a known part; of each text so many of the
    rarest pairs are posted that two similar texts must meet in one. Lengths
    are compared before pairs are made, each pair is scored once. Nothing is
    cut off: ``threshold`` has to be over 66.7, below which that part is all.
    """
    t = threshold / 100
    share = max(2 / t - 2, 4 * (1 - t) / (2 - t))
    if share >= 1:
        raise ValueError("similar_texts needs a threshold over 66.7")
    texts = [df.select(F.col(df.columns[0]).alias("s")).where("s != ''").distinct() for df in (a, b)]
    both = texts[0].withColumn("side", F.lit(1)).unionByName(texts[1].withColumn("side", F.lit(2))).groupBy("s").agg(F.bit_or("side").alias("sides"))
    marked = F.concat(F.lit("\x02"), F.col("s"), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substring(marked, i, F.lit(2)))
    grams = both.select("s", "sides", F.explode(pairs).alias("gram")).groupBy("s", "sides", "gram").agg(F.count(F.lit(1)).alias("k"))
    grams = grams.select("s", "sides", "gram", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("k"))
    often = grams.groupBy("gram", "k").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("s").orderBy("often", "gram", "k"))
    posted = grams.join(often, ["gram", "k"]).withColumn("place", place).where(F.col("place") <= F.floor(F.length("s") * F.lit(share) + 1e-9) + 1)
    x = posted.where("sides in (1, 3)").select("gram", "k", F.col("s").alias("a"))
    y = posted.where("sides in (2, 3)").select("gram", "k", F.col("s").alias("b"))
    near = 2 * F.least(F.length("a"), F.length("b")) >= t * (F.length("a") + F.length("b")) - 1e-9
    met = x.join(y, ["gram", "k"]).where(near).select("a", "b").distinct()
    return met.withColumn("score", score_of("a", "b")).where(F.col("score") >= threshold)


def best_match(raw: DataFrame, column: str, reference: DataFrame, name: str, order: str, threshold: float) -> DataFrame:
    """``(column, name, score)``: for each distinct text the reference of the highest token-sort ratio from ``threshold``; ties go to the least ``order``."""
    left = raw.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_a", words_sorted(F.col(column)))
    right = reference.select(F.col(name).alias("_name"), F.col(order).alias("_order")).withColumn("_b", words_sorted(F.col("_name")))
    right = right.groupBy("_b").agg(F.min_by(F.struct("_name", "_order"), "_order").alias("_r"))  # of names of the same words the first
    found = similar_texts(left.select("_a"), right.select("_b"), threshold)
    met = left.join(found.withColumnsRenamed({"a": "_a", "b": "_b"}), "_a").join(right, "_b")
    return met.groupBy(column).agg(F.min_by(F.struct(F.col("_r._name").alias(name), "score"), F.struct(-F.col("score"), F.col("_r._order"))).alias("_m")).select(column, f"_m.{name}", "_m.score")


@F.pandas_udf(StringType())
def titled(names: pd.Series) -> pd.Series:
    return names.map(lambda x: " ".join(x.title().split()), na_action="ignore")


def match_names(raw: DataFrame, column: str, canonical: Sequence[str] | DataFrame, rewrites: Sequence[tuple[str, str]] = (), threshold: float = 85.0) -> DataFrame:
    """``(column, canonical, method, confidence)`` for each distinct name: EXACT 100, PATTERN 95 (after ``rewrites``), FUZZY by score, else UNMAPPED 0.

    ``canonical`` is a list in order of precedence, or a DataFrame of any size
    whose first column is the name (precedence is then that of the text). Equal
    matches are equi-joins; only names that they leave over are compared, by
    ``similar_texts``. Ties go to the earlier name; names that differ only in case count as the last of them.
    """
    spark = raw.sparkSession
    if isinstance(canonical, DataFrame):
        names = canonical.select(F.col(canonical.columns[0]).alias("_name")).where("_name is not null").distinct().withColumn("_order", F.col("_name"))
    else:
        names = spark.createDataFrame([(x, i) for i, x in enumerate(canonical)], "_name string, _order int")
    by_lower = names.groupBy(F.lower("_name").alias("_key")).agg(F.max_by("_name", "_order").alias("_known"))
    rewritten = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rewrites, F.col(column))
    left = raw.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_p", F.trim(F.regexp_replace(rewritten, r"\s+", " ")))
    for key, text in (("_exact", F.lower(F.trim(column))), ("_pattern", F.lower("_p"))):
        left = left.join(by_lower.withColumnsRenamed({"_key": f"{key}_key", "_known": key}), text == F.col(f"{key}_key"), "left").drop(f"{key}_key")
    equal = F.coalesce("_exact", "_pattern")
    rest = left.where(equal.isNull()).select(column, titled("_p").alias("_text"))
    fuzzy = best_match(rest, "_text", names, "_name", "_order", threshold).withColumnsRenamed({"_name": "_fuzzy"})
    out = left.join(rest.join(fuzzy, "_text").select(F.col(column).alias("_c"), "_fuzzy", "score"), F.col(column) == F.col("_c"), "left")
    ladder = lambda a, b, c, d: F.when(F.col("_exact").isNotNull(), a).when(F.col("_pattern").isNotNull(), b).when(F.col("_fuzzy").isNotNull(), c).otherwise(d)
    method = ladder(*map(F.lit, ("EXACT", "PATTERN", "FUZZY", "UNMAPPED")))
    return out.select(column, F.coalesce(equal, "_fuzzy").alias("canonical"), method.alias("method"), ladder(F.lit(100.0), F.lit(95.0), F.round("score", 2), F.lit(0.0)).alias("confidence"))


#: What an organisation is called before its own name, long and short. Fixed values.
KINDS = ("DEPARTMENT OF", "DEPT OF", "OFFICE OF")
LONG, SHORT = "DEPARTMENT", "DEPT"


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(name), r"\s+", " "))


def name_variants(name: Column) -> Column:
    """The upper-case name and its other forms, without nulls and repeats: turned around its comma, its kind put behind a comma, and the kind long or short."""
    plain = plain_name(name)
    head, tail = F.trim(F.regexp_extract(plain, "^([^,]*),(.*)$", 1)), F.trim(F.regexp_extract(plain, "^([^,]*),(.*)$", 2))
    turned = [F.when(F.contains(plain, F.lit(",")), F.trim(F.concat_ws(" ", tail, head)))]
    turned += [F.when(F.startswith(plain, F.lit(k + " ")), F.concat(F.substring(plain, F.lit(len(k) + 2), F.length(plain)), F.lit(", " + k))) for k in KINDS]
    forms = F.filter(F.array(plain, *turned), lambda x: x.isNotNull())
    longer = F.transform(forms, lambda x: F.regexp_replace(x, rf"\b{SHORT}\b\.?", LONG))
    shorter = F.transform(forms, lambda x: F.regexp_replace(x, rf"\b{LONG}\b", SHORT))
    return F.array_distinct(F.concat(forms, shorter, longer))


def resolve_names(raw: DataFrame, column: str, reference: DataFrame, name: str, code: str, fuzzy_among: Column | None = None, threshold: float = 90.0) -> DataFrame:
    """``(column, code, method, score)`` for each distinct raw name: ``exact``, else by a ``variant``, else ``fuzzy``, else ``unresolved``.

    Names are compared in upper case with single blanks. ``fuzzy_among`` says
    which reference rows similar names may resolve to. Of reference rows of one
    name the least code counts; the first variant that is known counts. Names of blanks only are unresolved.
    """
    known = reference.where(F.col(name).isNotNull() & F.col(code).isNotNull()).withColumn("_plain", plain_name(F.col(name)))
    codes = known.groupBy("_plain").agg(F.min(code).alias("_code"))
    names = raw.select(column).where(F.col(column).isNotNull()).distinct()
    tried = names.select(column, F.posexplode(name_variants(F.col(column))).alias("_no", "_form")).join(codes, F.col("_form") == F.col("_plain"))
    equal = tried.groupBy(column).agg(F.min(F.struct("_no", F.col("_code").alias("_hit"))).alias("_e"))
    rest = names.join(equal, column, "left_anti").withColumn("_text", plain_name(F.col(column)))
    among = known if fuzzy_among is None else known.where(fuzzy_among)
    targets = among.groupBy("_plain").agg(F.min(code).alias("_code")).where("_plain != ''")
    near = best_match(rest, "_text", targets, "_plain", "_plain", threshold).join(targets, "_plain")
    near = rest.join(near, "_text").select(F.col(column).alias("_c"), F.col("_code").alias("_near"), "score")
    out = names.join(equal, column, "left").join(near, F.col(column) == F.col("_c"), "left")
    method = F.when(F.col("_e._no") == 0, "exact").when(F.col("_e").isNotNull(), "variant").when(F.col("_near").isNotNull(), "fuzzy").otherwise("unresolved")
    return out.select(column, F.coalesce("_e._hit", "_near").alias(code), method.alias("method"), F.when(F.col("_e").isNotNull(), 100.0).otherwise(F.coalesce(F.round("score", 2), F.lit(0.0))).alias("score"))
