"""How the sources of a language differ: term shares by group, divergence of every two sources, and the terms that stand out."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tenderlake.llm.common import Scratch

#: Bytes to bytes: A-Z in lower case, other letters as they are, all else of ASCII a blank. Bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PART = 1 << 22  # bytes of a text that are split at once
HELD = 200_000  # entries that a worker holds before it hands them on
UNIT, PRIOR = 1_000_000_000, 5
DIGIT = 10  # bits of a value that one histogram tells apart: at most 1,024 rows a group
COUNTS = "_lang string, _source string, _term string, n long, docs long"


def parts_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    plain, at = text.translate(FOLD), 0
    while at < len(plain):
        end = plain.find(b" ", at + PART)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by language and source, as far as a worker saw them; an empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            k = len(n) + 1
            terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * k), pa.array([source] * k), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, COUNTS.replace(" string", "").replace(" long", "").split(", "))
        held.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for part in parts_of(text.as_py()):
                n.update(part)
                seen.update(part)
            docs.update(seen)
            entries += len(n) - before
            if entries > HELD:
                yield from hand_on()
                entries = 0
    yield from hand_on()


def portion(n: str, total: str, kept: str) -> Column:
    """The smoothed share in billionths, in whole numbers of up to 38 digits."""
    return F.expr(f"1 + ((cast({n} as decimal(20,0)) + {PRIOR}) * {UNIT}) div (cast({total} as decimal(20,0)) + cast({PRIOR} * {kept} as decimal(20,0)))")


@F.pandas_udf(IntegerType())
def common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many first bytes two texts share."""
    return pd.Series([len(os.path.commonprefix([x.encode(), y.encode()])) for x, y in zip(a, b, strict=True)], dtype="int32")


def bucket_with(histogram: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The bucket in which each group's count reaches ``need``, and what is still needed of it; the last bucket if it never does."""
    by = Window.partitionBy(*keys)
    run = by.orderBy(order)
    told = histogram.withColumn("above", F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = told.withColumn("total", F.sum("n").over(by)).withColumn("last", F.row_number().over(run) == F.count(F.lit(1)).over(by))
    here = (F.col("above") < F.col("need")) & ((F.col("above") + F.col("n") >= F.col("need")) | F.col("last"))
    return told.where(here).withColumn("need", F.col("need") - F.col("above")).drop("above", "last")


def top_by_radix(scratch: Scratch, df: DataFrame, keys: Sequence[str], value: str, item: str, k: int) -> DataFrame:
    """Rows of the ``k`` greatest values of each group, ties by the UTF-8 bytes of ``item``, with ``rank``.

    Histograms over ten bits of the value at a time, counted where the rows
    are, close in on each group's k-th value. Where more rows have it than are
    needed, histograms over two bytes of the item after their common prefix
    close in on the last one that is. No group is sorted or gathered; only its
    k rows meet at last. Values are not negative; an item occurs once in a group.
    """
    most = df.agg(F.max(value)).first()[0]
    if most is None:
        return df.withColumn("rank", F.lit(0))
    digits = -(-max(int(most).bit_length(), 1) // DIGIT)
    state = df.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    for d in reversed(range(digits)):
        inside = df.join(state, keys).where(F.shiftright(value, DIGIT * (d + 1)) == F.col("prefix"))
        histogram = inside.groupBy(*keys, "need", F.shiftright(value, DIGIT * d).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        state = scratch.cut(bucket_with(histogram, keys, F.desc("prefix")).select(*keys, "prefix", "need", "n"))
    ties = scratch.cut(df.join(state, keys).where(F.col(value) == F.col("prefix")).select(*keys, item, "need"))
    bounds = scratch.cut(ties.groupBy(*keys, "need").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("low"), F.max(item).alias("high")))
    closed, still = [bounds.where("n <= need or low = high")], bounds.where("n > need and low < high")
    while not still.isEmpty():
        still = still.withColumn("shared", common_prefix("low", "high"))
        inside = ties.drop("need").join(still.select(*keys, "need", "low", "high", "shared"), keys).where(F.col(item).between(F.col("low"), F.col("high")))
        digit = F.substring(F.encode(item, "UTF-8"), F.col("shared") + 1, F.lit(2))
        histogram = inside.groupBy(*keys, "need", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("low"), F.max(item).alias("high"))
        bounds = scratch.cut(bucket_with(histogram, keys, F.asc("digit")).select(*keys, "need", "n", "low", "high"))
        closed.append(bounds.where("n <= need or low = high"))
        still = bounds.where("n > need and low < high")
    last = reduce(DataFrame.unionByName, closed).select(*keys, "high").join(state.select(*keys, F.col("prefix").alias("least")), keys)
    first = df.join(last, keys).where((F.col(value) > F.col("least")) | ((F.col(value) == F.col("least")) & (F.col(item) <= F.col("high"))))
    return first.drop("least", "high").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(item))))


def pair_divergence(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """``(_lang, _source, item, value)``: the summed differences of the shares of every two sources of a language.

    Where neither has a term, the shares are those of count 0, so a pair starts
    with V times their difference. Each source's own terms correct that (by
    the histogram of its shares, not term by term), and terms of both correct
    it once more. The corrections of a pair are added before they are shuffled.
    """
    a = groups.select("_lang", F.col("_source").alias("a"), F.col("base").alias("a0"), "kept")
    b = groups.select("_lang", F.col("_source").alias("b"), F.col("base").alias("b0"))
    start = a.join(b, "_lang").where("a != b").select("_lang", "a", "b", F.expr("kept * abs(a0 - b0) as v"))
    shares = postings.groupBy("_lang", F.col("_source").alias("a"), F.col("base").alias("a0"), "p").agg(F.count(F.lit(1)).alias("k"))
    own = shares.join(b, "_lang").where("a != b").select("_lang", "a", "b", F.expr("k * (abs(p - b0) - abs(a0 - b0)) as v")).groupBy("_lang", "a", "b").agg(F.sum("v").alias("v"))
    x = postings.select("_lang", "_term", F.col("_source").alias("a"), F.col("base").alias("a0"), F.col("p").alias("pa"))
    y = postings.select("_lang", "_term", F.col("_source").alias("b"), F.col("base").alias("b0"), F.col("p").alias("pb"))
    both = x.join(y, ["_lang", "_term"]).where("a < b").select("_lang", "a", "b", F.expr("abs(pa - pb) - abs(pa - b0) - abs(a0 - pb) + abs(a0 - b0) as v")).groupBy("_lang", "a", "b").agg(F.sum("v").alias("v"))
    turned = lambda df: df.select("_lang", F.col("b").alias("a"), F.col("a").alias("b"), "v")
    parts = [start, own, turned(own), both, turned(both)]
    return reduce(DataFrame.unionByName, parts).groupBy("_lang", F.col("a").alias("_source"), F.col("b").alias("item")).agg(F.sum("v").alias("value"))


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, k: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each two sources of a language are apart, and each source's ``k`` terms above the language's share.

    Terms are runs of ASCII letters and characters beyond ASCII; a language
    keeps those of at least ``min_docs`` of its documents. Null text, language
    and source count as empty strings, and the empty string is a language and
    a source like others. A source without terms has the shares of count 0; a
    language without kept terms gives pairs of value 0 and no terms. Repeated
    rows count as often as they stand; very long texts are counted whole, in
    parts; other columns are not read; an empty table gives an empty table.

    Counts are made by worker before they are shuffled, so a hot source sends
    its terms, not its words. Tables of counts are cut in the scratch folder.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "_lang"), (source_col, "_source"), (text_col, "_text"))])
    seen = own.mapInArrow(count_terms, COUNTS)
    counts = scratch.cut(seen.groupBy("_lang", "_source", "_term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("_term != ''").groupBy("_lang", "_term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    postings = scratch.cut(counts.drop("docs").where("_term != ''").join(terms, ["_lang", "_term"]))
    in_lang = postings.groupBy("_lang", "_term").agg(F.first("lang_n").alias("lang_n")).groupBy("_lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    in_group = postings.groupBy("_lang", "_source").agg(F.sum("n").alias("total"))
    groups = counts.where("_term = ''").select("_lang", "_source").join(in_group, ["_lang", "_source"], "left").join(in_lang, "_lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = scratch.cut(groups.withColumn("base", F.when(F.col("kept") > 0, portion("0", "total", "kept")).otherwise(F.lit(0))))
    postings = postings.join(groups, ["_lang", "_source"]).select("_lang", "_source", "_term", portion("n", "total", "kept").alias("p"), portion("lang_n", "lang_total", "kept").alias("q"), "base")
    postings = scratch.cut(postings)
    above = scratch.cut(postings.where("p > q").select("_lang", "_source", F.col("_term").alias("item"), F.expr("p - q as value")))
    terms = top_by_radix(scratch, above, ["_lang", "_source"], "value", "item", k)
    pairs = pair_divergence(groups, postings)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("_lang", "_source").orderBy(F.desc("value"), F.asc("item"))))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
