"""Prices and numbers as Column expressions. Three number readers with different rules stay apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# Units and currencies.
PER_M2 = r"(?iu)(/|на\s+|per\s+)\s*(m2|m²|кв\.?\s*м|кв\.м|sq\.?\s*m|square\s*met)"
CURRENCY = r"(?iu)(€|EUR|лв\.?|BGN)"
LEVA = r"(?iu)(лв|BGN)"
BGN_PER_EUR = 1.95583


def is_per_m2(raw: Column) -> Column:
    return F.coalesce(raw.rlike(PER_M2), F.lit(False))


def normalise(price: Column, area: Column, raw: Column) -> Column:
    """struct(total, per_m2): the quoted text alone decides which of the two the number is."""
    known = area.isNotNull() & (area != 0)
    rate = is_per_m2(raw) & price.isNotNull()
    total = F.when(rate, F.when(known, F.bround(price * area, 2))).otherwise(price)
    per_m2 = F.when(rate, price).when(known & (price != 0), F.bround(price / area, 2))
    return F.struct(total.alias("total"), per_m2.alias("per_m2"))


def price_line(raw: Column) -> Column:
    """The one line of a block that holds the price; null for a single line and where several could."""
    lines = F.filter(F.transform(F.split(raw, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    digits = lambda x: F.length(F.regexp_replace(x, r"(?U)\D", ""))
    numeric = F.filter(lines, lambda x: digits(x) > 0)
    priced = F.filter(numeric, lambda x: x.rlike(CURRENCY))
    # Of the lines with most digits, the first.
    most = F.array_max(F.transform(numeric, lambda x: digits(x)))
    longest = F.get(F.filter(numeric, lambda x: digits(x) == most), F.lit(0))
    return F.when(F.size(lines) >= 2, F.when(F.size(priced) == 1, F.get(priced, F.lit(0))).when((F.size(priced) == 0) & (F.size(numeric) >= 2), longest))


def value_of(text: Column) -> Column:
    """The first number of a price line: spaces group, a comma is a point, three digits at the end are thousands, 0 is
    unknown."""
    raw = F.regexp_extract(F.replace(text, F.lit(" "), F.lit(" ")), r"(?U)\d[\d\s.,]*", 0)
    flat = F.replace(F.regexp_replace(F.replace(raw, F.lit(" "), F.lit("")), r"[.,]+$", ""), F.lit(","), F.lit("."))
    last = F.substring_index(flat, ".", -1)
    head = F.substring(flat, F.lit(1), F.length(flat) - F.length(last) - 1)
    one_point = F.when(F.regexp_count(flat, F.lit(r"\.")) > 1, F.concat(F.replace(head, F.lit("."), F.lit("")), F.lit("."), last)).otherwise(flat)
    whole = F.when(one_point.contains(".") & (F.length(last) == 3), F.replace(one_point, F.lit("."), F.lit(""))).otherwise(one_point)
    number = whole.try_cast("double")
    return F.when(number != 0, number)


def number(text: Column) -> Column:
    """The first number on a page: the rightmost of comma and point is decimal; a lone comma is with one or two digits
    after it; a point with three digits at the end groups."""
    raw = F.regexp_extract(text, r"(?U)-?\d[\d\s.,]*", 0)
    flat = F.regexp_replace(F.regexp_replace(raw, r"(?U)\s", ""), r"[.,]+$", "")
    comma, point = F.instr(F.reverse(flat), ","), F.instr(F.reverse(flat), ".")
    no_points, no_commas = F.replace(flat, F.lit("."), F.lit("")), F.replace(flat, F.lit(","), F.lit(""))
    as_point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    clean = (
        F.when((comma > 0) & (point > 0), F.when(comma < point, as_point(no_points)).otherwise(no_commas))
        .when(comma > 0, F.when(flat.rlike(r",\d{1,2}$"), as_point(flat)).otherwise(no_commas))
        .when(flat.rlike(r"\.\d{3}$"), no_points)
        .otherwise(flat)
    )
    return clean.try_cast("double")


#: What groups digits beside points and commas: white space, apostrophes.
GROUP_MARKS = r"(?U)[\s'’]+"


def strict_number(text: Column) -> Column:
    """A whole text that is one number; anything else is null. With comma and point the one further right is decimal; alone,
    either groups if three digits follow it every time, else it is the decimal point."""
    return once(F.regexp_replace(text, GROUP_MARKS, ""), _strict)


def _strict(flat: Column) -> Column:
    comma, point = F.instr(F.reverse(flat), ","), F.instr(F.reverse(flat), ".")
    bare = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))
    as_point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    clean = (
        F.when((comma > 0) & (point > 0), F.when(comma < point, as_point(bare(flat, "."))).otherwise(bare(flat, ",")))
        .when(comma > 0, F.when(flat.rlike(r"^\d{1,3}(,\d{3})+$"), bare(flat, ",")).otherwise(as_point(flat)))
        .when(flat.rlike(r"^\d{1,3}(\.\d{3})+$"), bare(flat, "."))
        .otherwise(flat)
    )
    return F.when(flat.rlike(r"^-?\d+([.,]\d+)*$"), clean.try_cast("decimal(20,4)"))


def first_number(text: Column) -> Column:
    """The first run of digits and group marks, read strictly."""
    return strict_number(F.nullif(F.regexp_extract(text, r"(?U)\d[\d\s.,'’]*", 0), F.lit("")))


# Words for the floor at street level.
GROUND_WORDS = ("ground", "ground floor", "партер")


def single_integer(text: Column) -> Column:
    """A whole number, also as '3 of 8'; the ground floor is 0; anything else is null."""
    whole = F.nullif(F.regexp_extract(text, r"^(-?\d+)(?:\s+of\s+\d+)?$", 1), F.lit("")).try_cast("int")
    return F.when(F.lower(text).isin(*GROUND_WORDS), F.lit(0)).otherwise(whole)


def bounded_integer(text: Column, low: int = -3, high: int = 100) -> Column:
    """A whole number within bounds; the ground floor is 0."""
    bare = F.trim(text)
    return F.when(F.lower(bare) == "партер", F.lit(0)).otherwise(within(F.when(bare.rlike(r"^-?\d+$"), bare.try_cast("int")), low, high))


def money(text: Column) -> Column:
    """A quoted amount in euros; leva are converted."""
    value = number(text)
    return F.when(text.rlike(LEVA), F.bround(value / BGN_PER_EUR, 2)).otherwise(value)


def within(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)
