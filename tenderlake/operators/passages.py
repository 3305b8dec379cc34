"""Evidence back in its text: passages around matches that stand close, and where a quoted citation stands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters of a quote that are enough when the whole is not found.
SHORT = 40


def merge_passages(evidence: DataFrame, docs: DataFrame, doc: str, by: Sequence[str], text: str = "text", start: str = "start", end: str = "end", gap: int = 200, border: int = 150) -> DataFrame:
    """``(doc, by, passage, first, last, text, highlights, n)``: evidence of a document and group, merged where at most ``gap`` characters lie between one and the next.

    Offsets count characters from 0, ends are exclusive. A passage is widened
    by ``border`` on both sides within its text; ``highlights`` are the
    evidence's own spans, counted from the passage's start and in order. Spans
    that lie outside their text are cut or, if nothing is left, counted but
    not highlighted. Evidence without a start and documents without text give
    nothing. Texts are joined once the spans of a passage are known, not to each span.
    """
    known = evidence.where(F.col(start).isNotNull() & F.col(doc).isNotNull())
    order = Window.partitionBy(doc, *by).orderBy(start, end)
    fresh = F.coalesce((F.col(start) - F.lag(end).over(order) > gap).cast("int"), F.lit(1))
    marked = known.withColumn("_fresh", fresh).withColumn("passage", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(doc, *by, "passage").agg(F.min(start).alias("_first"), F.max(end).alias("_last"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(start).alias("start"), F.col(end).alias("end")))).alias("_spans"))
    joined = spans.join(docs.select(doc, F.col(text).alias("_text")).where(F.col(text) != ""), doc)
    first, last = F.greatest(F.col("_first") - border, F.lit(0)), F.least(F.col("_last") + border, F.length("_text"))
    cut = joined.withColumn("first", first.cast("long")).withColumn("last", F.greatest(last, first).cast("long"))
    inside = F.transform("_spans", lambda x: F.struct(F.greatest(x["start"] - F.col("first"), F.lit(0)).cast("long").alias("start"), F.least(x["end"] - F.col("first"), F.col("last") - F.col("first")).cast("long").alias("end")))
    slice_ = F.substring(F.col("_text"), (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int"))
    return cut.select(doc, *by, F.col("passage").cast("long").alias("passage"), "first", "last", slice_.alias("text"), F.filter(inside, lambda x: x["start"] < x["end"]).alias("highlights"), "n")


def tolerant(quote: Column) -> Column:
    """An expression that matches the quote with any white space where it has some."""
    plain = F.regexp_replace(quote, r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.regexp_replace(plain, r"\s+", r"\\s+")


def cite(rows: DataFrame, text: str, quote: str) -> DataFrame:
    """``rows`` with ``offset`` and ``how`` the quote was found in the text: the first of exact, case, space, space_case, part and part_case that finds it.

    The offset counts characters of the text itself from 0, also where the
    white space differs. ``part`` asks for the first 40 characters of a longer
    quote. Null or empty texts and quotes, and quotes that aren't found, have no offset.
    """
    t, q = F.col(text), F.col(quote)
    head = F.when(F.length(q) > SHORT, F.left(q, F.lit(SHORT)))
    at = {
        "exact": F.instr(t, q), "case": F.instr(F.lower(t), F.lower(q)), "space": F.regexp_instr(t, tolerant(q)), "space_case": F.regexp_instr(t, F.concat(F.lit("(?iu)"), tolerant(q))),
        "part": F.instr(t, head), "part_case": F.instr(F.lower(t), F.lower(head)),
    }
    found = F.lit(None).cast("struct<offset:long,how:string>")
    for how, place in reversed(at.items()):
        found = F.when(place > 0, F.struct((place - 1).cast("long").alias("offset"), F.lit(how).alias("how"))).otherwise(found)
    found = F.when((t != "") & (F.trim(q) != ""), found)
    return rows.withColumn("_found", found).select(*rows.columns, "_found.offset", "_found.how")
