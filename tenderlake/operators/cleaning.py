"""Data-quality rules from definitions: compiled to column expressions that clean nested records, with a counter for each rule in the same pass."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tenderlake.functions.columns import parse_date, split_clean, zip_code

# How a country without a code of its own is written, and the dates that are understood.
HOME = ("USA", "US", "")
DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "dd-MMM-yyyy")
ABSENT = ("", "N/A")


def country_code(c: Column) -> Column:
    """Upper case, without accents and blanks around; null for nothing."""
    plain = F.upper(F.trim(c))
    plain = F.translate(plain, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY")
    return F.when(plain != "", plain)


def at_home(country: Column) -> Column:
    return country.isNull() | F.upper(F.trim(country)).isin(*HOME)


def state_code(c: Column, country: Column) -> Column:
    """Two letters in the own country, what stands there elsewhere; a date is no state."""
    plain = F.trim(c)
    home = F.when(F.upper(plain).rlike("^[A-Z]{2}$"), F.upper(plain))
    return F.when((plain == "") | plain.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}"), None).when(at_home(country), home).otherwise(plain)


def iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` of the first form that fits; null if none does."""
    return parse_date(c, DATES).cast("string")


#: What a definition's ``action`` does with a value and the country that stands beside it.
ACTIONS: dict[str, Callable[[Column, Column], Column]] = {
    "clean_zip": lambda v, country: F.when(at_home(country), zip_code(v)).otherwise(F.trim(v)),
    "clean_state": state_code,
    "normalize_country": lambda v, country: country_code(v),
    "normalize_date": lambda v, country: iso_date(v),
    "first_code": lambda v, country: F.get(split_clean(v, ","), 0),
    "fix_pipes": lambda v, country: F.replace(v, F.lit("|\\|"), F.lit("||")),
    "blank_absent": lambda v, country: F.when(~F.upper(F.trim(v)).isin(*ABSENT), F.trim(v)),
}


def has_path(kind: DataType, path: Sequence[str]) -> bool:
    for step in path:
        name, listed = step.removesuffix("[]"), step.endswith("[]")
        if not isinstance(kind, StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
        if listed:
            if not isinstance(kind, ArrayType):
                return False
            kind = kind.elementType
    return True


def _change(node: Column | None, path: Sequence[str], change: Callable[[Column, Callable[[str], Column]], Column], of: Callable[[str], Column]) -> Column:
    """The value at ``path`` below ``node`` rewritten; ``of`` reads a neighbour of the value by name. A null on the way stays null."""
    step, rest = path[0], path[1:]
    name, listed = step.removesuffix("[]"), step.endswith("[]")
    here = of(name)

    def inner(x: Column) -> Column:
        if not rest:
            return change(x, of)
        child = rest[0].removesuffix("[]")
        return F.when(x.isNotNull(), x.withField(child, _change(x, rest, change, lambda n: x[n])))

    return F.transform(here, inner) if listed else inner(here)


def _count(path: Sequence[str], test: Callable[[Column, Callable[[str], Column]], Column], of: Callable[[str], Column]) -> Column:
    """For how many values at ``path`` of a row ``test`` is true."""
    step, rest = path[0], path[1:]
    name, listed = step.removesuffix("[]"), step.endswith("[]")

    def inner(x: Column) -> Column:
        return _count(rest, test, lambda n: x[n]) if rest else F.when(F.coalesce(test(x, of), F.lit(False)), 1).otherwise(0).cast("long")

    here = of(name)
    if not listed:
        return inner(here)
    return F.coalesce(F.aggregate(F.transform(here, inner), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))


def parsed_rules(rules: Sequence[Mapping]) -> list[dict]:
    """Active rules by priority, then in the order given; a definition may be JSON text."""
    active = [dict(r) for r in rules if r.get("is_active", "Y") == "Y"]
    for r in active:
        definition = r.get("rule_definition") or {}
        r["rule_definition"] = json.loads(definition) if isinstance(definition, str) else dict(definition)
    return sorted(active, key=lambda r: r.get("priority", 100))


def apply_rules(df: DataFrame, rules: Sequence[Mapping], name: str = "quality_rules") -> tuple[DataFrame, Observation]:
    """``df`` after all active rules, and an observation of how often each one fired; no row is ever dropped.

    A rule has ``rule_name``, ``target_column`` (a path: fields by dots, ``[]``
    behind a list whose elements are meant), ``rule_type`` and a
    ``rule_definition`` with an ``action``. CLEAN replaces a value and counts
    changes, TRANSFORM replaces it by what could be converted and counts that,
    VALIDATE counts values over ``max_length``. ``country_field`` names the
    neighbour that tells the country. Nulls and empty texts are left alone.
    Rules for columns that the table doesn't have do nothing; unknown actions
    are an error. Counters are complete once an action has run over the result.
    """
    counters: list[Column] = []
    out = df
    for i, rule in enumerate(parsed_rules(rules)):
        path, definition, kind = rule["target_column"].split("."), rule["rule_definition"], rule["rule_type"]
        if not has_path(out.schema, path):
            counters.append(F.sum(F.lit(0)).alias(rule["rule_name"]))
            continue
        action, beside = definition.get("action"), definition.get("country_field", "countryCode")
        top = path[0].removesuffix("[]")

        def country(of: Callable[[str], Column], path: Sequence[str] = path, beside: str = beside, schema: StructType = out.schema) -> Column:
            return of(beside) if has_path(schema, [*path[:-1], beside]) else F.lit(None).cast("string")

        filled = lambda v: v.isNotNull() & (v.cast("string") != "")
        if kind == "VALIDATE":
            if action != "warn_length":
                raise ValueError(f"unknown action {action} of {rule['rule_name']}")
            most = int(definition.get("max_length", 2))
            fired = lambda v, of, most=most: F.length(v.cast("string")) > most
        else:
            if action not in ACTIONS or kind not in ("CLEAN", "TRANSFORM"):
                raise ValueError(f"unknown action {action} of {rule['rule_name']}")
            made = lambda v, of, do=ACTIONS[action], country=country: do(v, country(of))
            if kind == "CLEAN":
                fired = lambda v, of, made=made: filled(v) & ~v.eqNullSafe(made(v, of))
                new = lambda v, of, made=made: F.when(filled(v), made(v, of)).otherwise(v)
            else:
                fired = lambda v, of, made=made: filled(v) & made(v, of).isNotNull()
                new = lambda v, of, made=made: F.when(filled(v), F.coalesce(made(v, of), v)).otherwise(v)
        out = out.withColumn(f"_fired_{i}", _count(path, fired, lambda n: F.col(f"`{n}`")))
        counters.append(F.coalesce(F.sum(f"_fired_{i}"), F.lit(0)).alias(rule["rule_name"]))
        if kind != "VALIDATE":
            out = out.withColumn(top, _change(None, path, new, lambda n: F.col(f"`{n}`")))
    observation = Observation(name)
    return out.observe(observation, F.count(F.lit(1)).alias("rows"), *counters).select(*[F.col(f"`{c}`") for c in df.columns]), observation


def _address(path: str) -> list[dict]:
    rule = lambda field, action: {"rule_name": f"{path}.{field}", "target_column": f"{path}.{field}", "rule_type": "CLEAN", "rule_definition": {"action": action}}
    return [rule("countryCode", "normalize_country"), rule("zipCode", "clean_zip"), rule("stateOrProvinceCode", "clean_state")]


def _dates(path: str, *fields: str) -> list[dict]:
    return [{"rule_name": f"{path}.{f}", "target_column": f"{path}.{f}", "rule_type": "CLEAN", "rule_definition": {"action": "normalize_date"}} for f in fields]


#: The rules of a nested entity record: code, dates, both addresses and those of its contacts, certification dates.
ENTITY_RULES = [
    {"rule_name": "cage_code", "target_column": "entityRegistration.cageCode", "rule_type": "CLEAN", "rule_definition": {"action": "first_code"}},
    *_dates("entityRegistration", "registrationDate", "lastUpdateDate", "registrationExpirationDate", "activationDate", "ueiExpirationDate", "ueiCreationDate"),
    *_address("coreData.physicalAddress"),
    *_address("coreData.mailingAddress"),
    {"rule_name": "incorporation", "target_column": "coreData.generalInformation.countryOfIncorporationCode", "rule_type": "CLEAN", "rule_definition": {"action": "normalize_country"}},
    *_dates("coreData.entityInformation", "entityStartDate", "fiscalYearEndCloseDate", "submissionDate"),
    *_address("pointsOfContact.governmentBusinessPOC"),
    *_address("pointsOfContact.electronicBusinessPOC"),
    *_address("pointsOfContact.pastPerformancePOC"),
    *_dates("assertions.goodsAndServices.naicsList[]", "certificationEntryDate", "certificationExitDate"),
]
