"""Column functions for catalog text: trims, canonical form, the five number parsers, prices, HTML, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a table reader takes as missing (fixed values).
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def canonical(x: Column) -> Column:
    """Lower case, only a-z and 0-9 kept: `8 mm` and `8mm` are one."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def half_even(x: Column, digits: int) -> Column:
    """Rounding with ties to even. Works on the decimal text of a double."""
    return F.bround(x, digits)


def parse_price(x: Column) -> Column:
    """First number, commas removed: `$1,299.00` -> 1299.0; no sign."""
    return F.regexp_replace(F.regexp_substr(x, F.lit(r"\d[\d,]*(?:\.\d+)?")), ",", "").try_cast("double")


def comparison_number(x: Column) -> Column:
    """Commas removed first, then the first signed number."""
    return F.regexp_substr(F.regexp_replace(x, ",", ""), F.lit(r"-?\d+(?:\.\d+)?")).try_cast("double")


def fit_number(x: Column) -> Column:
    """First signed number; a comma ends it: `1,299` -> 1."""
    return F.regexp_substr(x, F.lit(r"-?\d+(?:\.\d+)?")).try_cast("double")


def constraint_number(x: Column) -> Column:
    """First signed number with commas inside it."""
    return F.regexp_replace(F.regexp_substr(x, F.lit(r"-?\d[\d,]*(?:\.\d+)?")), ",", "").try_cast("double")


def price_number(x: Column) -> Column:
    """The number of a price as text: `$1,299.00` -> `1299.00`."""
    return F.regexp_substr(F.regexp_replace(x, ",", ""), F.lit(r"\d+(?:[.,]\d+)?"))


def clean_price(x: Column) -> Column:
    """Trimmed text with its currency; null for blanks, `nan`, `none` and text without a digit."""
    t = strip(x)
    return F.when(t.rlike(r"\d") & ~F.lower(t).isin("nan", "none"), t)


def strip_html(x: Column) -> Column:
    """Tags and five entities become blanks, runs of white space one blank; null becomes empty."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"&nbsp;|&amp;|&quot;|&#39;", " ")
    return strip(F.regexp_replace(t, r"\s+", " "))


def snake_case(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ordered_list(sort: list[Column], value: Column) -> Column:
    """Aggregate: values in the order of sort, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(sort)], value.alias("v"))))), lambda x: x["v"])
