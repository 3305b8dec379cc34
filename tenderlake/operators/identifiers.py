"""Identifiers in texts: contract and solicitation numbers, entity and clause numbers, each with its own check and the words that must stand near it."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters around a match, and how many contract numbers make a text a parts catalogue.
NEAR, CONTEXT, CATALOGUE = 200, 150, 100
SHORTEST = 12
TYPE_CODES = "ABCDEFGHLMNPQRSTWK"
SOLICITATION_CODES, CONTRACT_CODES = "RQB", "CDFGH"

FOUND = "kind string, value string, raw string, start long, end long, confidence string, context string"


class IdRule(NamedTuple):
    """``near``: an expression of which a match has to stand within NEAR characters. ``plain``: hyphens are left out of the value."""

    kind: str
    pattern: str
    near: str | None = None
    check: Callable[[str], bool] | None = None
    plain: bool = False
    confidence: str = "medium"


def is_contract_number(value: str) -> bool:
    """Two letters and two digits at least, and a type code behind the two digits of a year that follow an office of five or six characters."""
    letters, digits = sum(map(str.isalpha, value)), sum(map(str.isdigit, value))
    return len(value) >= SHORTEST and letters >= 2 and digits >= 2 and re.match(rf".{{5,6}}\d\d[{TYPE_CODES}]", value) is not None


def contract_kind(value: str) -> str:
    """SOLICITATION if one of the two places for a type code has that of a solicitation and the other none of a contract."""
    seventh, eighth = value[7:8], value[8:9]
    for here, other in ((seventh, eighth), (eighth, seventh)):
        if here and here in SOLICITATION_CODES and not (other and other in CONTRACT_CODES):
            return "SOLICITATION"
    return "PIID"


def is_mixed(value: str) -> bool:
    return any(map(str.isdigit, value)) and any(map(str.isalpha, value)) and not is_contract_number(value)


# The forms of identifiers, and the words that have to stand near the weaker ones. No I and no O.
CHAR = "[A-HJ-NP-Z0-9]"
CONTRACT_RULES = (
    IdRule("PIID", rf"\b({CHAR}{{4,6}}\d{{2}}[A-Z]{CHAR}{{3,8}})\b", None, is_contract_number, True),
    IdRule("PIID", rf"\b({CHAR}{{2,6}}(?:-{CHAR}{{1,8}}){{2,5}})\b", r"\b(?:contract|solicitation|PIID|award|(?:delivery|task|purchase)\s+order|requisition|RFP|RFQ|IFB)\b", is_contract_number, True),
)
OTHER_RULES = (
    IdRule("UEI", rf"\b([A-HJ-NP-Z1-9]{CHAR}{{11}})\b", r"\b(?:UEI|Unique\s+Entity|SAM\.gov|SAM\s+registration)\b", is_mixed),
    IdRule("CAGE", rf"\b(\d{CHAR}{{3}}\d)\b", r"\bCAGE\b", None, False, "high"),
    IdRule("DUNS", r"\b(\d{9})\b", r"\bDUNS\b"),
    IdRule("FAR_CLAUSE", r"\b(52\.2\d{2}-\d{1,3})\b", None, None, False, "high"),
    IdRule("DFARS_CLAUSE", r"\b(252\.2\d{2}-7\d{3})\b", None, None, False, "high"),
    IdRule("WAGE_DET", r"\b(20\d{2}-\d{4,6})\b", r"\b(?:wage\s+determination|SCA|DBA|Davis.?Bacon|Service\s+Contract\s+Act|WD\s+(?:No|Number|#))\b"),
    IdRule("GSA_SCHEDULE", r"\b(GS-?\d{2}F-?\d{4,5}[A-Z]?)\b", None, None, True, "high"),
    IdRule("USASPENDING_ID", r"\b(CONT_(?:AWD|IDV)_[A-Z0-9_\-]+)\b", None, None, False, "high"),
)


def _matches(text: str, rules: Sequence[tuple[IdRule, re.Pattern, re.Pattern | None]]) -> Iterator[tuple]:
    """Accepted matches in order of rules, then of the text; words that have to stand near are found once for each rule that has a match."""
    for rule, pattern, near in rules:
        places: list[tuple[int, int]] | None = None
        for m in pattern.finditer(text):
            value = m[1].upper().replace("-", "") if rule.plain else m[1].upper()
            if rule.check and not rule.check(value):
                continue
            if near is not None:
                if places is None:
                    places = [w.span() for w in near.finditer(text)]
                k = bisect_left(places, (m.start() - NEAR, 0))  # the first word that lies wholly in reach
                if k == len(places) or places[k][1] > m.end() + NEAR:
                    continue
            yield rule, value, m


def extract_identifiers(docs: DataFrame, id_col: str, text_col: str, contract_rules: Sequence[IdRule] = CONTRACT_RULES, rules: Sequence[IdRule] = OTHER_RULES) -> DataFrame:
    """``(id, kind, value, raw, start, end, confidence, context)``: each identifier of a whole text once, where it stands first.

    Contract numbers are told apart from those of solicitations by their type
    code; a text with over CATALOGUE of them is a catalogue of parts and has
    none. Offsets count characters from 0. Null texts have no identifiers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [[(r, re.compile(r.pattern), re.compile(r.near, re.IGNORECASE) if r.near else None) for r in group] for group in (contract_rules, rules)]
        for batch in batches:
            out = []
            for key, text in zip(batch[id_col], batch[text_col], strict=True):
                first: dict[str, tuple] = {}  # of one number in two spellings the first rule's
                n = 0
                for rule, value, m in _matches(text, ready[0]):
                    n += value not in first or "-" not in m[1]
                    first.setdefault(value, (contract_kind(value), rule, m))
                found = [] if n > CATALOGUE else [(kind, value, rule, m) for value, (kind, rule, m) in first.items()]
                seen = set()
                for rule, value, m in _matches(text, ready[1]):
                    if (rule.kind, value) not in seen:
                        seen.add((rule.kind, value))
                        found.append((rule.kind, value, rule, m))
                for kind, value, rule, m in found:
                    a, b = m.span(1)
                    out.append((key, kind, value, m[1], a, b, rule.confidence, text[max(0, a - CONTEXT) : b + CONTEXT]))
            yield pd.DataFrame(out, columns=[id_col, *(f.split()[0] for f in FOUND.split(", "))])

    return docs.select(id_col, text_col).where(F.col(text_col) != "").mapInPandas(scan, f"`{id_col}` {id_type}, {FOUND}")


def notice_refs(found: DataFrame, doc: str, attachments: DataFrame, notice: str, by: Sequence[str]) -> DataFrame:
    """``(notice, by, mention_count)``: identifiers of a notice's documents with how often they are named; a document may hang on several notices."""
    return found.join(attachments.select(doc, notice), doc).groupBy(notice, *by).agg(F.count(F.lit(1)).alias("mention_count"))


def predecessors(found: DataFrame, doc: str, attachments: DataFrame, notice: str, awards: DataFrame, award_id: str, carry: Sequence[str]) -> DataFrame:
    """``(notice, award_id, carry, confidence, document_mentions)``: earlier awards whose number a notice's documents name, with the number of such documents."""
    numbers = found.where(F.col("kind").isin("PIID", "SOLICITATION")).select(doc, F.col("value").alias(award_id), "confidence")
    named = numbers.join(attachments.select(doc, notice), doc).groupBy(notice, award_id, "confidence").agg(F.count_distinct(doc).alias("document_mentions"))
    return named.join(awards.select(award_id, *carry), award_id).select(notice, award_id, *carry, "confidence", "document_mentions")
