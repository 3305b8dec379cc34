"""Column expressions: identifiers, numbers, dates, JSON, URLs and HTML. No Python runs on rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_id(c: Column) -> Column:
    """An identifier for matching: upper case, only letters and digits; null if nothing is left."""
    out = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return F.when(out != "", out)


def money(c: Column) -> Column:
    return c.cast("decimal(15,2)")


def safe_pct(part: Column, whole: Column, places: int = 1) -> Column:
    """100 * part / whole, rounded; null where the whole is null or zero."""
    return F.when(whole != 0, F.round(100.0 * part / whole, places))


def fiscal_year(day: Column, first_month: int = 10) -> Column:
    """The year that a fiscal year starting in ``first_month`` ends in."""
    return (F.year(day) + (F.month(day) >= first_month).cast("int")).cast("long")


def record_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the columns in name order, null as empty; the order they are given in has no effect."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns)]), 256)


def strip_html(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]+)", 1))


def json_number(c: Column, key: str) -> Column:
    return F.get_json_object(c, f"$.{key}").cast("long")


def bucket(c: Column, ladder: Sequence[tuple[float, str]], least: str) -> Column:
    """The label of the first step, from the top, that the value reaches; null for null."""
    out = F.lit(least)
    for at, label in sorted(ladder):
        out = F.when(c >= at, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def eq_nullsafe_false(a: Column, b: Column) -> Column:
    """Equality that is false, not null, where a side is null."""
    return F.coalesce(a == b, F.lit(False))


def contains_text(c: Column, needle: str) -> Column:
    """Contains, without case; nothing in ``needle`` is a wildcard."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def enum_rank(c: Column, values: Sequence[str]) -> Column:
    """Place in ``values`` from 1; 0 for others and for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)).cast("long")


def truncated(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def strip_numeral(c: Column) -> Column:
    """Without one roman numeral from I to X at the end."""
    return F.regexp_replace(c, r"(?i) (X|IX|VIII|VII|VI|V|IV|III|II|I)$", "")


def split_clean(c: Column, separator: str) -> Column:
    """Trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def flagged_codes(c: Column, separator: str = "~") -> Column:
    """``(code, flag)`` of each part: the flag is its last character if that is Y or N."""
    has = lambda x: F.right(x, F.lit(1)).isin("Y", "N")
    return F.transform(split_clean(c, separator), lambda x: F.struct(F.when(has(x), F.left(x, F.length(x) - 1)).otherwise(x).alias("code"), F.when(has(x), F.right(x, F.lit(1))).alias("flag")))


def zip_code(c: Column) -> Column:
    """12345 or 12345-6789 from what digits there are; null if there are fewer than five."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 9, F.concat(F.substring(digits, 1, 5), F.lit("-"), F.substring(digits, 6, 4))).when(F.length(digits) >= 5, F.substring(digits, 1, 5))


def parse_date(c: Column, formats: Sequence[str]) -> Column:
    """The date by the first of the formats that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]).cast("date")


def parse_decimal(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[,$]", "").try_cast("decimal(15,2)")


def months_apart(first: Column, last: Column, inclusive: bool = False) -> Column:
    """Months by calendar fields, days ignored."""
    return ((F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + int(inclusive)).cast("long")


def true_keys(c: Column) -> Column:
    """Keys of a JSON object whose value is true, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(F.from_json(c, "map<string,boolean>"), lambda _, v: F.coalesce(v, F.lit(False)))))


def industry_level(code: Column) -> Column:
    """Level and parent of a hierarchical code: 2 digits are level 1, each further digit is one level deeper."""
    plain = F.regexp_replace(code, "[A-Za-z]+$", "")
    return F.struct((F.length(plain) - 1).cast("long").alias("level"), F.when(F.length(plain) > 2, F.left(plain, F.length(plain) - 1)).alias("parent"))


def guid(c: Column) -> Column:
    """The first 32 hexadecimal digits in a row, in lower case; null if there are none."""
    found = F.regexp_extract(c, "[0-9A-Fa-f]{32}", 0)
    return F.when(found != "", F.lower(found))


def value_ratio(a: Column, b: Column) -> Column:
    """The smaller by the greater, 0 to 1; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))
