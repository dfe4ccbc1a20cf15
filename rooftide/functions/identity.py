"""What makes two listings the same: keys without prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, title_norm

TITLE_CHARS, AREA_STEP, LEAST_PARTS, KEY_CHARS = 24, 5, 3, 16


def dedup_key(location: Column, title: Column, bedrooms: Column, area: Column, floor: Column, given: Column | None = None) -> Column:
    """The given group, else a hash of what is known; '' with fewer than three known parts. Areas round half to even."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rounded = (F.bround(area / AREA_STEP, 0) * AREA_STEP).cast("long")
    parts = [fold(location), F.left(title_norm(title), F.lit(TITLE_CHARS)), blank(bedrooms.cast("long")), blank(rounded), blank(floor.cast("long"))]
    known = sum((p != "").cast("int") for p in parts)
    key = F.when(known < LEAST_PARTS, F.lit("")).otherwise(F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(KEY_CHARS)))
    return key if given is None else F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(key)


def cluster_key(city: Column, deal: Column, key: Column) -> Column:
    """Groups never cross cities or deals; without a key or a city there is none."""
    return F.when(city.isNotNull() & (F.coalesce(key, F.lit("")) != ""), F.concat_ws(":", city, deal, key)).otherwise(F.lit(""))


def web_fingerprint(url: Column) -> Column:
    return F.concat(F.lit("web"), F.left(F.sha1(url), F.lit(13)))
