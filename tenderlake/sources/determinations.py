"""Wage determinations: fixed-width texts read whole, a determination each, with its rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators.relational import join_null_safe

# Names of states and their codes.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT",
    "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "PUERTO RICO": "PR",
    "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
SHORTEST = 100

MONEY = r"\$[ \t]*([\d,]+\.\d{2})"
#: What is asked of the lines of a text; of several lines that answer the last one counts.
HEADER = {
    "wd_number": r"(?im)^(?=.*WAGE DETERMINATION NO).*?(\d{4}-\d{4,5})",
    "revision": r"(?im)^(?!.*WAGE DETERMINATION NO)(?=.*REVISION NO).*?(\d+)",
    "effective": r"(?im)^(?=.*DATE OF (?:LAST )?REVISION).*?(\d{1,2}/\d{1,2}/\d{4})",
    "state": r"(?im)^[ \t]*STATES?[ \t]*:[ \t]*(.*?)[ \t]*$",
    "area": r"(?im)^[ \t]*AREA[ \t]*:[ \t]*(.*(?:\n(?![ \t]*(?:$|OCCUPATION|_{4,}|-{4,}|\*\*|FRINGE)).*)*)",
    "health_welfare": rf"(?im)^(?=.*HEALTH)(?=.*(?:WELFARE|H&W)).*?{MONEY}",
    "vacation": rf"(?im)^[ \t]*VACATION(?=.*:).*?{MONEY}",
    "holiday": rf"(?im)^[ \t]*HOLIDAY(?=.*:).*?{MONEY}",
    "eo_minimum_wage": rf"(?im)^(?=.*EXECUTIVE ORDER)(?=.*MINIMUM WAGE).*?{MONEY}",
}
RATE = r"(?m)^[ \t]*(\d{5})[ \t]*-[ \t]*(.+?)[ \t]{2,}\$?[ \t]*([\d,]+\.\d{2})[ \t]*$"
SECTION = r"(?ims)^[^\n]*OCCUPATION CODE[^\n]*(?:TITLE|RATE)[^\n]*\n(.*?)(?=^[ \t]*(?:__|--|THE APPLICABLE)|^[^\n]*(?:HEALTH & WELFARE|HEALTH AND WELFARE|FRINGE BENEFITS|THE APPLICABLE)|\z)"
NOTE = r"(?im)^[ \t]*(\d{5})[ \t]*-[ \t]*(.+?)[ \t]+(?:\*+[ \t]*)?(?:see note|varies|negotiated)[^\n]*$"


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def _entry(line: Column, pattern: str, rate: bool) -> Column:
    title = F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, pattern, 2)), r"-+$", ""))
    amount = F.replace(F.regexp_extract(line, pattern, 3), F.lit(",")).try_cast("decimal(12,2)") if rate else F.lit(None).cast("decimal(12,2)")
    return F.struct(F.regexp_extract(line, pattern, 1).alias("occupation_code"), title.alias("occupation_title"), amount.alias("hourly_rate"))


def parse_determinations(texts: DataFrame, text: str = "value") -> DataFrame:
    """``texts`` with the header fields, fringe amounts and ``occupations`` of each text; texts of fewer than 100 characters and nulls are left out.

    Quotes around the whole are taken off. A rate stands at the end of its
    line, two blanks or more behind the title, anywhere in the text; a line
    that only refers to a note has a null rate and counts within a section of
    occupations, which a rule of dashes or the fringe benefits end. An area
    goes on over the lines below it up to a blank one or the next heading.
    """
    plain = F.regexp_replace(F.trim(F.col(text)), r"\r\n?", "\n")
    plain = F.when(F.startswith(plain, F.lit('"')) & F.endswith(plain, F.lit('"')) & (F.length(plain) > 1), F.substring(plain, F.lit(2), F.length(plain) - 2)).otherwise(plain)
    rows = texts.where(F.length(text) >= SHORTEST).withColumn("_t", plain)
    for name, pattern in HEADER.items():
        rows = rows.withColumn(name, _last(F.col("_t"), pattern))
    state = F.upper(F.trim(F.split("state", ",")[0]))
    code = F.coalesce(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[state], F.when(state.rlike("^[A-Z]{2}$"), state))
    area = F.trim(F.regexp_replace("area", r"[ \t]*\n[ \t]*", " "))
    rated = F.transform(F.regexp_extract_all("_t", F.lit(RATE), F.lit(0)), lambda x: _entry(x, RATE, True))
    sections = F.array_join(F.regexp_extract_all("_t", F.lit(SECTION), F.lit(1)), "\n")
    noted = F.filter(F.regexp_extract_all(sections, F.lit(NOTE), F.lit(0)), lambda x: ~x.rlike(RATE))
    amounts = {n: F.replace(F.col(n), F.lit(",")).try_cast("decimal(12,2)") for n in ("health_welfare", "vacation", "holiday", "eo_minimum_wage")}
    return rows.select(
        *texts.columns, "wd_number", F.col("revision").try_cast("int").alias("revision"), F.to_date(F.try_to_timestamp("effective", F.lit("M/d/yyyy"))).alias("effective_date"), "state", code.alias("state_code"), area.alias("area_name"),
        F.when(area.isNotNull(), F.concat_ws(" - ", "state", area)).alias("title"), *[v.alias(n) for n, v in amounts.items()], F.concat(rated, F.transform(noted, lambda x: _entry(x, NOTE, False))).alias("occupations"),
    )


def scan_determinations(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file, read whole; a determination is one text, so one task parses it."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_determinations(texts).drop("value")


def rates_of(determinations: DataFrame) -> DataFrame:
    """``(wd_number, revision, occupation_code, occupation_title, hourly_rate)``: a row a rate with the key of its determination.

    Of one code the first of its text counts; where several texts have one
    number and revision, a rate before a note, then the least title and rate.
    """
    codes = F.transform("occupations", lambda o: o["occupation_code"])
    once = F.filter("occupations", lambda o, i: F.array_position(codes, o["occupation_code"]) == i + 1)
    rows = determinations.where(F.col("wd_number").isNotNull()).select("wd_number", "revision", F.explode(once).alias("_o"))
    order = F.struct(F.col("_o.hourly_rate").isNull(), "_o.occupation_title", "_o.hourly_rate")
    first = rows.groupBy("wd_number", "revision", F.col("_o.occupation_code").alias("occupation_code")).agg(F.min_by("_o", order).alias("_o"))
    return first.select("wd_number", "revision", "occupation_code", "_o.occupation_title", "_o.hourly_rate")


def with_current(determinations: DataFrame, keys: Sequence[str] = ("wd_number",)) -> DataFrame:
    """One row of ``keys`` and a revision, the newest of each marked ``is_current``; a determination without a revision is the oldest.

    ``keys`` tell determinations apart: where offices number theirs by themselves, the office is one of them. Rows without a number are left out.
    """
    known = determinations.where(F.col("wd_number").isNotNull())
    newest = known.groupBy(*keys).agg(F.max(F.coalesce("revision", F.lit(-1))).alias("_n"))
    joined = join_null_safe(known, newest, keys)
    return joined.withColumn("is_current", F.coalesce("revision", F.lit(-1)) == F.col("_n")).drop("_n").dropDuplicates([*keys, "revision"])
