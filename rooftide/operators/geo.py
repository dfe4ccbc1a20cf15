"""Places: alias lookup by n-grams, the longest alias wins, two cities are nobody's, neighbours of resorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import geo_norm, has_phrase, lit_array, words

# Settlements outside the target cities, and words that must stand before ambiguous aliases.
OUTSIDE = (
    "kavarna", "byala", "obzor", "burgas", "plovdiv", "ruse", "balchik", "slanchev bryag", "sunny beach", "albena", "nesebar",
    "sozopol", "pomorie", "bansko", "sveti vlas",
)
NEEDS_PREFIX = ("bulgaria", "balgariya")
PREFIXES = ("kv", "zh k", "kvartal", "district")
# Resorts that a buyer takes for one another.
CLUSTERS = (
    ("Свети Влас", "Несебър", "Слънчев бряг", "Равда", "Елените", "Кошарица", "Тънково"),
    ("Поморие", "Ахелой", "Каблешково"),
    ("Бургас", "Сарафово", "Крайморие", "Черноморец"),
    ("Созопол", "Черноморец", "Дюни", "Приморско", "Китен", "Лозенец"),
    ("Царево", "Ахтопол", "Синеморец", "Лозенец"),
    ("Обзор", "Бяла", "Шкорпиловци"),
    ("Варна", "Златни пясъци", "Св. Константин и Елена", "Свети Никола", "Бяла"),
    ("Албена", "Балчик", "Каварна", "Златни пясъци"),
)
SURE, CITY_ONLY, UNSURE = "0.95", "0.40", "0.00"


def phrase_grams(text: Column, longest: int) -> Column:
    """All distinct runs of 1 to longest words; each length grows from the one below."""
    w = words(text)
    runs = [w]
    for n in range(2, longest + 1):
        grown = F.zip_with(runs[-1], F.slice(w, n, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.array_compact(grown))
    return F.filter(F.array_distinct(F.concat(*runs)), lambda x: x != "")


def _longest(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, alias, place) of found without aliases that another alias of the same text contains. One aggregate: what a text
    matches is no more than the vocabulary."""
    grouped = found.groupBy(*by).agg(F.collect_set(F.struct("alias", "place")).alias("all"))
    inside = lambda x: F.exists("all", lambda y: (y["alias"] != x["alias"]) & has_phrase(y["alias"], x["alias"]))
    return grouped.select(*by, F.explode(F.filter("all", lambda x: ~inside(x))).alias("x")).select(*by, "x.alias", "x.place")


def alias_matches(texts: DataFrame, aliases: DataFrame, longest: int, keys: list[str] | None = None) -> DataFrame:
    """(id, alias, place): aliases (keys, alias, place) in the normalised texts (id, keys, text) at word borders. Word runs
    meet aliases by equality; an alias that another found one contains does not count."""
    keys = keys or []
    runs = texts.select("id", *keys, F.explode(phrase_grams(F.col("text"), longest)).alias("alias"))
    return _longest(runs.join(aliases, [*keys, "alias"]), ["id", *keys])


def resolve(offers: DataFrame, cities: DataFrame, aliases: DataFrame, longest: int = 4) -> DataFrame:
    """(id, city, neighbourhood, normalized_location, confidence, matched_by).

    offers: id, location, location_raw, source_city. cities: slug, name_bg, name_en. aliases: city, alias (normalised), place.
    A city needs exactly one match in the text; another settlement in the location rules all out; only without any
    match does the source's own city count. A neighbourhood needs exactly one place left in that city."""
    text = geo_norm(F.concat_ws(" ", F.nullif(F.col("location"), F.lit("")), F.nullif(F.col("location_raw"), F.lit(""))))
    base = offers.select("id", text.alias("text"), geo_norm(F.col("location")).alias("primary"), "source_city")
    names = cities.select("slug", F.explode(F.array_distinct(F.array(*(geo_norm(F.col(c)) for c in ("slug", "name_bg", "name_en"))))).alias("alias"))
    supported = [r[0] for r in names.select("alias").distinct().collect()]  # a curated dimension, like the aliases
    outside = [x for x in OUTSIDE if x not in supported]
    base = base.withColumn("outside", F.exists(lit_array(outside), lambda x: has_phrase(F.col("primary"), x)))
    in_text = alias_matches(base.where("NOT outside").select("id", "text"), names.withColumnRenamed("slug", "place"), longest)
    hits = in_text.groupBy("id").agg(F.collect_set("place").alias("cities"))
    known = F.col("source_city").isin([r[0] for r in cities.select("slug").distinct().collect()])
    by_text = F.when(F.size("cities") == 1, F.col("cities")[0])
    by_source = F.when(F.col("cities").isNull() & ~F.col("outside") & known, F.col("source_city"))
    located = base.join(hits, "id", "left").withColumn("city", F.coalesce(by_text, by_source))
    located = located.withColumn("method", F.when(by_text.isNotNull(), "city_text").when(by_source.isNotNull(), "source_city").otherwise("unresolved"))
    found = alias_candidates(located.where("city IS NOT NULL").select("id", "city", "text"), aliases, longest)
    places = found.groupBy("id").agg(F.collect_set("place").alias("places"))
    out = located.join(places, "id", "left").withColumn("neighbourhood", F.when(F.size("places") == 1, F.col("places")[0]))
    sure = F.col("neighbourhood").isNotNull()
    return out.select(
        "id",
        "city",
        "neighbourhood",
        F.col("text").alias("normalized_location"),
        F.when(sure, SURE).when(F.col("city").isNotNull(), CITY_ONLY).otherwise(UNSURE).alias("confidence"),
        F.when(sure, "alias").otherwise(F.col("method")).alias("matched_by"),
    )


def alias_candidates(texts: DataFrame, aliases: DataFrame, longest: int) -> DataFrame:
    """As alias_matches within a city, but ambiguous aliases count only after a prefix word."""
    runs = texts.select("id", "city", "text", F.explode(phrase_grams(F.col("text"), longest)).alias("alias"))
    ok = ~F.col("alias").isin(*NEEDS_PREFIX) | F.exists(lit_array(PREFIXES), lambda p: has_phrase(F.col("text"), F.concat(p, F.lit(" "), F.col("alias"))))
    return _longest(runs.join(aliases, ["city", "alias"]).where(ok), ["id"])


def adjacent_to(chosen: DataFrame, clusters: DataFrame) -> DataFrame:
    """Places (place) that share a cluster (cluster, place) with a chosen one, without the chosen."""
    touched = clusters.join(chosen, "place", "left_semi").select("cluster").distinct()
    return clusters.join(touched, "cluster", "left_semi").select("place").distinct().join(chosen, "place", "left_anti")


def first_longest_alias(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Canonical name of the longest alias that text (folded) contains anywhere; equal lengths in the given order.
    aliases: a curated vocabulary of (folded alias, name)."""
    out = F.lit(None).cast("string")
    for alias, name in sorted(aliases, key=lambda x: len(x[0])):
        out = F.when(F.contains(text, F.lit(alias)), F.lit(name)).otherwise(out)
    return out


# First halves of names that many places share.
QUALIFIERS = (
    "sveti", "svety", "saint", "st", "sv", "svetoy", "svyatoy", "свети", "св", "святой", "златни", "zlatni", "golden", "слънчев",
    "sunny", "солнечный", "стар", "old", "нов", "new", "k", "s",
)


def distinctive_words(aliases: list[tuple[str, str]]) -> dict[str, str]:
    """word -> name: words of four letters or more that the aliases of one place alone hold."""
    owners: dict[str, set[str]] = {}
    for alias, name in aliases:
        for word in alias.split():
            if len(word) >= 4 and word not in QUALIFIERS:
                owners.setdefault(word, set()).add(name)
    return {w: min(names) for w, names in owners.items() if len(names) == 1}


def first_longest_alias_or_word(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """As first_longest_alias; where no alias is found, the place of the first word that only its aliases hold. For texts that
    somebody reads back, not for ingestion."""
    known = distinctive_words(aliases)
    if not known:
        return first_longest_alias(text, aliases)
    table = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    loose = F.get(F.filter(F.transform(words(text), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first_longest_alias(text, aliases), loose)
