"""Who holds a contract now: names captured from texts, one name a notice by votes, and the only entity whose name has it."""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Capture(NamedTuple):
    """What introduces a name, what may end one, and what shows that it is none. Fixed values."""

    titles: tuple[str, ...] = ("incumbent contractor", "incumbent", "current contractor")
    verbs: tuple[str, ...] = ("is", "was")
    marks: str = ":=–—"
    phrases: tuple[str, ...] = ("currently performed by", "awarded to", "contract held by")
    endings: tuple[str, ...] = ("Inc", "LLC", "Corp", "Ltd", "LP", "LLP", "Co")
    staff: tuple[str, ...] = ("staff", "personnel", "employees", "office", "agency", "department", "officials", "team")

    def pattern(self) -> str:
        """One expression without look-around: an introduction, the name as group 1, and the next word or number in brackets as group 2."""
        any_of = lambda words: "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + ")"
        word = r"[A-Z][A-Za-z0-9&'-]*"
        intro = rf"(?:{any_of(self.titles)}(?:\s+{any_of(self.verbs)}\s+|\s*[{self.marks}]\s*)|{any_of(self.phrases)}\s+)"
        return rf"\b{intro}({word}(?:\s+{word})*(?:,\s*{any_of(self.endings)}\b\.?)?)(\s*\(\d|\s+[a-z]+)?"


#: Words that begin no name; a lexicon of function words, to be widened by the caller.
STOPS = (
    "a", "an", "the", "this", "that", "these", "those", "all", "any", "each", "every", "no", "not", "none", "such", "other", "and", "or", "but", "if", "for", "from", "with", "by", "to", "of", "in", "on", "at", "as", "per", "under", "over",
    "is", "are", "was", "were", "be", "been", "has", "have", "had", "will", "shall", "must", "may", "can", "should", "see", "how", "what", "when", "where", "which", "who", "why", "unknown", "tbd", "n/a", "na", "section", "question", "response",
)


def capture_names(docs: DataFrame, id_col: str, text_col: str, capture: Capture = Capture(), stops: Collection[str] = STOPS, common: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``(id, place, name)`` and the columns ``carry`` for each accepted capture in a whole text, ``place`` in order of the text.

    A capture is dropped if it has fewer than 2 or more than 100 characters,
    begins with a stop word, is numbered like a question, is followed by a word
    for an agency's own staff, or has only words of ``stops`` and ``common``
    (a DataFrame of lower-case words, of any size). Null texts capture nothing.
    """
    pattern = capture.pattern()
    name = lambda h: F.regexp_replace(F.trim(F.regexp_extract(h, pattern, 1)), r"[.,;:]+$", "")
    told = lambda h: F.struct(name(h).alias("name"), F.lower(F.trim(F.regexp_extract(h, pattern, 2))).alias("next"))
    hits = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), told)
    rows = docs.select(id_col, *carry, F.posexplode(hits).alias("place", "_hit")).select(id_col, *carry, "place", F.col("_hit.name").alias("name"), F.col("_hit.next").alias("_next"))
    words = F.split(F.lower("name"), r"\s+")
    own = F.filter(words, lambda w: ~w.isin(*stops))
    rows = rows.where(F.length("name").between(2, 100) & ~words[0].isin(*stops) & (F.size(own) > 0) & ~F.col("_next").rlike(r"^\(\d") & ~F.col("_next").isin(*capture.staff)).drop("_next")
    if common is None:
        return rows
    rare = rows.withColumn("_word", F.explode(F.array_distinct(own))).join(common.select(F.col(common.columns[0]).alias("_word")).distinct(), "_word", "left_anti")
    return rows.join(rare.select(id_col, "place").distinct(), [id_col, "place"], "left_semi")


def common_words(docs: DataFrame, text_col: str, at_least: int) -> DataFrame:
    """``(word)``: what stands in lower case in at least ``at_least`` rows, and is thus no name by itself."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"\b[a-z]+\b"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select("word")


def settle_names(names: DataFrame, by: str, name: str, weight: Column) -> DataFrame:
    """``(by, name, votes, weight, n_names)``: the name that most documents of a notice give, without case; then that of most weight, then the least."""
    votes = names.where(F.col(name).isNotNull()).groupBy(by, F.lower(F.trim(name)).alias("_key")).agg(F.count(F.lit(1)).alias("votes"), F.sum(weight).alias("weight"), F.min(name).alias(name))
    best = F.min_by(F.struct(name, "votes", "weight"), F.struct(-F.col("votes"), F.col("weight").isNull(), -F.col("weight"), "_key"))
    return votes.groupBy(by).agg(best.alias("_best"), F.count(F.lit(1)).alias("n_names")).select(by, "_best.*", "n_names")


#: Lengths of the runs of characters by which names are looked up.
RUNS = (1, 2, 4, 8, 16)


def only_holder(names: DataFrame, name: str, entities: DataFrame, entity_id: str, entity_name: str) -> DataFrame:
    """``(name, n_holders, entity_id)``: how many entities have the name within theirs, without case, and the id where it is exactly one.

    Every name of an entity, once for all that have it, is posted under its runs
    of ``RUNS`` characters; a wanted name asks for the rarest of its own, of the
    longest such length that it has, and only what meets there is compared.
    """
    wanted = names.select(F.col(name).alias("_name")).where("_name != ''").distinct().withColumn("_low", F.lower("_name"))
    held = entities.groupBy(F.lower(entity_name).alias("_full")).agg(F.min(entity_id).alias("_id"), F.count(F.lit(1)).alias("_rows")).where("_full != ''")

    def grams(text: str, size: int | Column) -> Column:
        size = F.lit(size) if isinstance(size, int) else size
        n = F.length(text) - size + 1
        return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col(text), i, size)))).otherwise(F.array().cast("array<string>"))

    posted = held.select("_id", "_rows", "_full", F.explode(F.concat(*[grams("_full", k) for k in RUNS])).alias("_gram"))
    longest = reduce(lambda w, k: w.when(F.length("_low") >= k, k), reversed(RUNS), F.when(F.lit(False), 0))
    asked = wanted.select("_name", "_low", F.explode(grams("_low", longest)).alias("_gram"))
    often = posted.join(asked.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    rarest = asked.join(often, "_gram", "left").groupBy("_name", "_low").agg(F.min_by("_gram", F.struct(F.coalesce("_often", F.lit(0)), "_gram")).alias("_gram"))
    met = rarest.join(posted, "_gram").where(F.contains("_full", "_low"))
    told = met.groupBy("_name").agg(F.sum("_rows").alias("_n"), F.min("_id").alias("_only"))
    out = wanted.join(told, "_name", "left")
    return out.select(F.col("_name").alias(name), F.coalesce("_n", F.lit(0)).alias("n_holders"), F.when(F.col("_n") == 1, F.col("_only")).alias(entity_id))
