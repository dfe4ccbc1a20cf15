"""Three-valued facts read from text: true, false, or null where the data does not say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taxonomy import stage_of
from .text import fold, fold_part, trimmed

#: Our own list; the parking words the market uses.
PARKING_WORDS = ("паркомясто", "паркоместа", "паркинг", "гараж", "парковка", "parking", "garage", "stellplatz")

# Token -> (words for, words against, columns read).
FEATURES = {
    "sea_view": (
        ("море", "морска", "морски", "sea", "seaview", "sea view", "meer", "на море", "к морю", "морето", "панорама към морето", "front line sea"),
        ("без гледка", "no sea", "двор", "улица", "паркинг"),
        ("view", "title", "notes"),
    ),
    "pool_view": (("басейн", "бассейн", "pool", "заведение басейн"), (), ("view", "title", "notes")),
    "mountain_view": (("планина", "горы", "mountain", "берг"), (), ("view", "title", "notes")),
    "pool": (("басейн", "бассейн", "pool", "swimming"), (), ("title", "notes", "view")),
    "furnished": ((), (), ("furnished",)),
    "parking": (PARKING_WORDS, (), ("title", "notes", "documents")),
    "act16": (
        ("акт 16", "акт16", "act 16", "act16", "акт 16 готов", "въведен в експлоатация"),
        ("акт 14", "act 14", "в строеж", "предстои акт 16"),
        ("documents", "notes", "status", "ready_date"),
    ),
    "new_build": (("ново строителство", "новостроящ", "new build", "новострой", "в строеж"), (), ("title", "notes", "documents")),
    "first_line": (
        ("първа линия", "first line", "первая линия", "frontline", "front line", "на плажа", "on the beach"),
        (),
        ("title", "notes", "view"),
    ),
    "lift": (("асансьор", "лифт", "lift", "elevator"), (), ("notes", "title")),
    "garden": (("двор", "градина", "сад", "garden", "yard"), (), ("title", "notes", "view")),
}
VIEWS = ("sea_view", "pool_view", "mountain_view")
# Phrases of the buyers' side.
PETS_NO = (
    r"без домашни любимци|не се допускат домашни|не са позволени домашни|no pets|pets (?:are )?not allowed|без животни"
)
PETS_YES = (
    r"домашни любимци (?:са )?(?:позволени|разрешени|добре дошли)|(?:допускат|приемат) се домашни любимци|pet[- ]friendly|"
    r"pets (?:are )?(?:allowed|welcome)"
)
NOT_THERE = {
    "lift": r"без асансьор|няма асансьор|no (?:lift|elevator)",
    "parking": r"без паркомясто|няма паркомясто|без паркинг|no parking",
    "garden": r"без двор|без градина|няма двор|no (?:garden|yard)",
}
ACT16_LATER = (
    r"(?U)(?:без|няма|очакван\w*|предстои)\s+акт\s*-?\s*16|"
    r"акт\s*-?\s*16\s*(?:се очаква|през|до края|в края|очакван|планиран)"
)


def _holds(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in phrases), F.lit(False))


def _python_fold(word: str) -> str:
    import re
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return re.sub(r"[^\w\s]+", " ", bare.casefold()).strip()


def folded(columns: dict[str, Column], fields: tuple[str, ...]) -> Column:
    """The text that tokens read these fields in."""
    return fold(F.concat_ws(" ", *(columns[f] for f in fields if f in columns)))


def folded_parts(columns: dict[str, Column]) -> dict[str, Column]:
    """Parts of those texts by column; null where the column is."""
    return {name: F.when(c.isNotNull(), fold_part(c.cast("string"))) for name, c in columns.items()}


def joined(parts: dict[str, Column], fields: tuple[str, ...]) -> Column:
    """folded, from folded_parts."""
    return trimmed(F.concat_ws(" ", *(parts[f] for f in fields if f in parts)))


def feature(token: str, columns: dict[str, Column], spec: dict | None = None, texts: dict[tuple[str, ...], Column] | None = None) -> Column:
    """true / false / null for one token; columns: those that the listing has, by name. Words against come first; no
    text is no answer; only a described view that shows something else is a no. texts: folded texts by the fields that
    they join, where they are columns already."""
    known = (spec or FEATURES).get(token)
    if known is None:
        return F.lit(None).cast("boolean")
    if token == "furnished":
        return columns.get("furnished", F.lit(None)).cast("boolean")
    yes, no, fields = known
    text = (texts or {}).get(fields, folded(columns, fields))
    other = F.lit(None).cast("boolean")
    if token in VIEWS and "view" in columns:
        other = F.when((texts or {}).get(("view",), fold(columns["view"])) != "", F.lit(False))
    answer = F.when(_holds(text, map(_python_fold, no)), F.lit(False)).when(_holds(text, map(_python_fold, yes)), F.lit(True)).otherwise(other)
    return F.when(text != "", answer)


def resolve(columns: dict[str, Column], spec: dict | None = None, texts: dict[tuple[str, ...], Column] | None = None) -> Column:
    """map token -> boolean with the tokens that are decided."""
    tokens = list(spec or FEATURES)
    every = F.map_from_arrays(F.array(*map(F.lit, tokens)), F.array(*(feature(t, columns, spec, texts) for t in tokens)))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def field_sets(spec: dict | None = None) -> list[tuple[str, ...]]:
    """The sets of fields that tokens read, and the view's own."""
    return sorted({fields for token, (_, _, fields) in (spec or FEATURES).items() if token != "furnished"} | {("view",)})


def pets_allowed(title: Column, notes: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, notes))
    return F.when(text.rlike(PETS_NO), F.lit(False)).when(text.rlike(PETS_YES), F.lit(True))


def requirement(token: str, columns: dict[str, Column], spec: dict | None = None) -> Column:
    """A buyer's requirement: denials first, a planned permit is not one, a stage decides about the permit."""
    text = F.lower(F.concat_ws(" ", *(c.cast("string") for c in columns.values())))
    out = feature(token, columns, spec)
    if token == "act16":
        stage = stage_of(text)
        out = F.when(text.rlike(ACT16_LATER), F.lit(False)).when(stage.isNotNull(), stage == "act16").otherwise(out)
    if token in NOT_THERE:
        out = F.when(text.rlike(NOT_THERE[token]), F.lit(False)).otherwise(out)
    return out
