"""Pattern rules over texts, their consolidation, name matching and cross-references."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reach in characters, and ranks.
AHEAD, BACK, QUESTION, ANSWER, CONTEXT, SECTION = 80, 60, 200, 40, 100, 2000
RANK = {"low": 1, "medium": 2, "high": 3}

MATCH_SCHEMA = "category string, rule string, rule_no int, value string, confidence string, matched string, start long, end long, denied boolean, context string"


class Rule(NamedTuple):
    """``value`` None: the matched text tells nothing but that the category occurs."""

    category: str
    name: str
    pattern: str
    value: str | None = None
    confidence: str = "medium"
    headings: tuple[str, ...] = ()


class Denial(NamedTuple):
    """Words that deny what stands in their scope: the clause, and no farther than a fixed reach.

    A clause ends at a mark of punctuation, a line or a table bar, or at a word
    of ``breaks``. A match is denied if, in its clause, a word of ``negators``
    or ``ahead_only`` stands before it; if a verb of ``links`` with a negator
    or a word of ``released`` follows it; if an example is announced right
    before it; or if all that is said of it is an empty answer: after a colon
    or a bar, or after the question that it stands in.
    """

    negators: tuple[str, ...] = ("no", "not", "never", "neither", "nor", "cannot", "n/a")
    ahead_only: tuple[str, ...] = ("without", "lacks", "lacking", "exempt", "exempts", "exempted", "exempting", "exemption", "waive", "waives", "waiving")
    released: tuple[str, ...] = ("waived", "exempt", "optional", "unnecessary", "inapplicable", "dropped")
    links: tuple[str, ...] = ("is", "are", "was", "were", "be", "been", "will", "shall", "does", "do", "did", "has", "have")
    answers: tuple[str, ...] = ("no", "none", "nil", "n/a")
    examples: tuple[str, ...] = ("e.g.", "such as", "for example", "for instance")
    breaks: tuple[str, ...] = ("but", "however", "although", "unless", "except")

    def cues(self) -> dict[str, re.Pattern]:
        def words(*lists: tuple[str, ...]) -> str:
            ranked = sorted({w for x in lists for w in x}, key=len, reverse=True)
            return r"(?<![\w/])(?:" + "|".join(map(re.escape, ranked)) + r")(?![\w/])"

        patterns = {
            "before": words(self.negators, self.ahead_only) + r"|n['\u2019]t\b",
            "after": rf"{words(self.links)}\s+(?:{words(self.negators, self.released)})",
            "end": r"[,;:.!?|()\n]|" + words(self.breaks),
            "answer": rf"[:?|][\s|*-]*{words(self.answers)}\s*(?=[.,;|)\n]|$)",
            "example": rf"(?:{'|'.join(map(re.escape, self.examples))})\s*$",
        }
        return {k: re.compile(v, re.IGNORECASE) for k, v in patterns.items()}


class Marks:
    """What one pass over a text finds of cues, clauses, headings and bold marks; matches are looked up in the sorted places."""

    HEADING = re.compile(r"^#{1,4}[^\S\n]+(\S.*)$", re.MULTILINE)

    def __init__(self, text: str, cues: dict[str, re.Pattern]):
        places = lambda name: [m.start() for m in cues[name].finditer(text)] if name in cues else []
        self.text, self.example = text, cues.get("example")
        self.before, self.after, self.answers = places("before"), places("after"), set(places("answer"))
        self.ends = [m.span() for m in cues["end"].finditer(text)] if cues else []
        self.marks = [a for a, _ in self.ends if text[a] in ":?|"]
        self.headings = [(m.end(), m[1].lower()) for m in self.HEADING.finditer(text)]
        self.bold = [m.start() for m in re.finditer(r"\*\*", text)]

    def denies(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, (start, start))
        opens = self.ends[k - 1][1] if k else 0
        k = bisect_left(self.ends, (end, end))
        closes = self.ends[k][0] if k < len(self.ends) else len(self.text)
        return self._stands(self.before, max(opens, start - AHEAD), start) or self._stands(self.after, end, min(closes, end + BACK)) or self._is_example(start) or self._is_unanswered(end)

    def _stands(self, places: list[int], first: int, last: int) -> bool:
        k = bisect_left(places, first)
        return k < len(places) and places[k] < last

    def _is_example(self, start: int) -> bool:
        return bool(self.example and self.example.search(self.text, max(0, start - ANSWER), start))

    def _is_unanswered(self, end: int) -> bool:
        """The next mark that asks for an answer gets an empty one: a colon or bar right behind the match, or the end of its question."""
        k = bisect_left(self.marks, end)
        if k == len(self.marks) or self.marks[k] not in self.answers:
            return False
        at = self.marks[k]
        return at < end + QUESTION if self.text[at] == "?" else not self.text[end:at].strip()

    def confidence(self, start: int, rule: Rule) -> str:
        """The rule's own; a step up in bold, ``high`` under a nearest heading that has one of its words."""
        k = bisect_right(self.headings, (start, "\U0010ffff")) - 1
        if k >= 0 and start - self.headings[k][0] <= SECTION and any(w in self.headings[k][1] for w in rule.headings):
            return "high"
        k = bisect_right(self.bold, start - 2) - 1
        if k >= 0 and start - self.bold[k] <= 5:
            return "medium" if rule.confidence == "low" else "high"
        return rule.confidence


def scan_patterns(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text", denial: Denial | None = Denial()) -> DataFrame:
    """A row for each match of each rule in whole texts, with offsets; denied ones are marked, not dropped. Null: no match.

    Cues, headings and bold marks are found once for a text that has a match;
    a match then costs a few binary searches. ``denial`` None denies nothing.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(no, r, re.compile(r.pattern, re.IGNORECASE)) for no, r in enumerate(rules)]
        cues = denial.cues() if denial else {}
        for batch in batches:
            out = []
            for key, text in zip(batch[id_col], batch[text_col]):
                hits = [(no, rule, m) for no, rule, pattern in compiled for m in pattern.finditer(text)]
                marks = Marks(text, cues) if hits else None
                for no, rule, m in hits:
                    a, b = m.span()
                    out.append((key, rule.category, rule.name, no, rule.value, marks.confidence(a, rule), m[0], a, b, marks.denies(a, b), text[max(0, a - CONTEXT) : b + CONTEXT]))
            yield pd.DataFrame(out, columns=[id_col, *(f.split()[0] for f in MATCH_SCHEMA.split(", "))])

    return docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInPandas(scan, f"`{id_col}` {id_type}, {MATCH_SCHEMA}")


def consolidate(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """By document and category: the best value (confidence, then having a value, then rule and place) and the counts.

    Partial aggregates do the work before the shuffle; no list of a document's matches is gathered.
    """
    rank = reduce(lambda w, kv: w.when(F.col("confidence") == kv[0], kv[1]), RANK.items(), F.when(F.lit(False), 0)).otherwise(0)
    order = F.struct(rank, F.col("value").isNotNull(), -F.col("rule_no"), -F.col("start"))
    best = F.max_by(F.struct("value", "confidence", "rule"), order)
    out = matches.where("not denied").groupBy(id_col, "category").agg(best.alias("_b"), F.count(F.lit(1)).alias("n"), F.count_distinct("rule", "matched").alias("n_different"))
    return out.select(id_col, "category", "_b.value", "_b.confidence", "_b.rule", "n", "n_different")


def cross_reference(ids: DataFrame, column: str, targets: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``ids`` with ``target`` and ``target_id``: the first of ``targets`` (name, DataFrame of key and target_id) that knows the identifier.

    One union, one aggregate by key and one join, however many targets there are; of a target's ids the least counts.
    """
    tagged = reduce(DataFrame.unionByName, [t.select(F.col("key"), F.struct(F.lit(i).alias("no"), F.lit(name).alias("target"), F.col("target_id").cast("string").alias("target_id")).alias("_t")) for i, (name, t) in enumerate(targets)])
    first = tagged.where("key is not null").groupBy("key").agg(F.min("_t").alias("_t"))
    return ids.join(first, F.col(column) == F.col("key"), "left").select(*ids.columns, "_t.target", "_t.target_id")


def reverse_search(refs: DataFrame, column: str, wanted: Column | str) -> DataFrame:
    """The rows that name an identifier, compared without case and separators."""
    plain = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return refs.where(plain(F.col(column)) == plain(F.lit(wanted) if isinstance(wanted, str) else wanted))
