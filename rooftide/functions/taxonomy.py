"""Construction stages, kinds, rooms, floors, deals as ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stages in the order in which they are tried; "before" must win over the bare milestone.
STAGES = (
    ("pre_act16", r"(?iu)пред\s*акт\s*-?\s*16|преди\s*акт\s*-?\s*16", "Пред Акт 16"),
    ("pre_act14", r"(?iu)пред\s*акт\s*-?\s*14", "Пред Акт 14"),
    ("act16", r"(?iu)акт\s*-?\s*16|акт16", "Акт 16"),
    ("act15", r"(?iu)акт\s*-?\s*15|акт15", "Акт 15"),
    ("act14", r"(?iu)акт\s*-?\s*14|акт14", "Акт 14"),
)
NEW_BUILD = (
    r"(?iu)(ново\s*строителство|новостроящ|ново-строителство|в\s*строеж|новопостроен|ново\s*строителна|"
    r"new\s*(?:build|construction)|до\s*ключ|на\s*зелено|off[- ]plan)"
)
# The search filter's own, different list.
NEW_BUILD_TOKENS = (
    "ново строителство", "новострой", "в строеж", "новопостроен", "на зелено", "до ключ", "акт 14", "акт 15", "акт 16",
    "акт14", "акт15", "акт16", "new construction",
)
# Kinds by page text, in order.
KIND_WORDS = (
    ("villa", r"(?iu)(вил[ла]|villa|вилла)"),
    ("townhouse", r"(?iu)(таунхаус|townhouse|town house|редова къща)"),
    ("penthouse", r"(?iu)(пентхаус|penthouse)"),
    ("maisonette", r"(?iu)(мезонет|maisonette|мезонин)"),
    ("house", r"(?iuU)(къща|house|\bдом\b|дома\b|haus)"),
    ("land", r"(?iuU)(парцел|\bземя\b|\bland\b|\bplot\b|участок)"),
    ("office", r"(?iu)(офис|office)"),
    ("shop", r"(?iuU)(магазин|\bshop\b|\bstore\b)"),
    ("hotel", r"(?iu)(хотел|hotel)"),
)
# Kind groups of the search.
KIND_GROUPS = {
    "apartment": (
        "апартамент", "едностаен", "двустаен", "тристаен", "четиристаен", "многостаен", "мезонет", "студио", "ателие",
        "пентхаус", "apartment", "maisonette", "penthouse", "studio", "atelier",
    ),
    "house": ("къщ", "вил", "house", "villa", "cottage", "mansion"),
    "land": ("парцел", "земеделска земя", "land", "plot"),
    "commercial": (
        "офис", "магазин", "заведение", "хотел", "office", "shop", "hotel", "beauty parlor", "hair salon", "children's area",
        "dental office", "промишлен", "industrial", "factory", "storage room", "warehouse", "склад", "производствен",
        "индустриал", "търговск", "ресторант", "кафене", "бизнес", "сграда", "спа", "restaurant", "cafe", "café",
        "business", "pharmacy", "dry cleaning", "beauty centre",
    ),
}
# Rooms by kind, and written-out rooms.
ROOMS_BY_KIND = (("едностаен", 1), ("студио", 1), ("двустаен", 2), ("тристаен", 3), ("четиристаен", 4))
ROOM_WORDS = (
    (1, r"(?iu)(едностаен|однокомнатн|one[- ]room|1[- ]staen)"),
    (2, r"(?iu)(двустаен|двухкомнатн|two[- ]room)"),
    (3, r"(?iu)(тристаен|трехкомнатн|трёхкомнатн|three[- ]room)"),
    (4, r"(?iu)(четиристаен|четырехкомнатн|четырёхкомнатн|four[- ]room)"),
)
# Counts of rooms and bedrooms, studios, rents and sales that are over, in page text.
BEDROOMS = r"(?iu)(\d)\s*[-\s]?\s*(?:спалн|bedroom|schlafzimmer)"
ROOMS_DIGIT = r"(?iu)(\d)\s*[-\s]?(?:х\s*)?(?:стаен|стайн|комнатн|комнат|room)"
STUDIO = r"(?iu)(студи|studio|monolocale|einzimmer)"
RENT = r"(?iu)(под наем|наем|аренда|for rent|rental|на нощувка|per night)"
SOLD = r"(?iu)(прода(?:н|ден)|sold|резервиран|зарезервирован|reserved|капаро|снят с продаж)"
# Floors in words, from the first up.
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth",
    "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
)
LOWEST_FLOOR, HIGHEST_FLOOR = -3, 100
# The second taxonomy, of sources that name all rooms: names by number, then kinds in order.
ROOM_NAMES = {1: "Едностаен апартамент", 2: "Двустаен апартамент", 3: "Тристаен апартамент", 4: "Четиристаен апартамент"}
MANY_ROOMS = "Многостаен апартамент"
NAMED_ROOMS = (("едностаен", 1), ("двустаен", 2), ("тристаен", 3), ("четиристаен", 4))
OTHER_KINDS = (
    ("Мезонет", "мезонет"), ("Студио", "студио"), ("Апартамент", "апартамент"), ("Къща", "къща|вила"), ("Парцел", "парцел"),
    ("Магазин", "магазин"), ("Промишлено помещение", r"пром(?:ишлено|\.)?\s+помещение"), ("Склад", "склад"), ("Офис", "офис"),
    ("Гараж", "гараж|паркомясто"),
)
# What a source says about pets.
PET_FACT = (
    r"(?iu)((?:Не се допускат|Без|Допускат се|Приемат се)\s+домашни любимци|"
    r"Домашни любимци\s+(?:са )?(?:разрешени|позволени|не са позволени))"
)


def first_match(text: Column, rules, otherwise: Column | None = None) -> Column:
    """The name of the first of (name, pattern) that is found in text."""
    out = F.lit(None) if otherwise is None else otherwise
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def any_token(text: Column, tokens) -> Column:
    """Case-insensitive substring; tokens are literal."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(t.lower()) for t in tokens))


def stage_of(text: Column) -> Column:
    return first_match(text, [s[:2] for s in STAGES])


def stage_label(text: Column) -> Column:
    return first_match(text, [(s[2], s[1]) for s in STAGES])


def is_new_build(text: Column) -> Column:
    return F.coalesce(text.rlike(NEW_BUILD) | stage_of(text).isNotNull(), F.lit(False))


def kind_clause(group: str, kind: Column, title: Column, groups: dict | None = None) -> Column:
    tokens = (groups or KIND_GROUPS)[group]
    return any_token(kind, tokens) | any_token(title, tokens)


def new_build_clause(title: Column, notes: Column) -> Column:
    return any_token(title, NEW_BUILD_TOKENS) | any_token(notes, NEW_BUILD_TOKENS)


def kind_of(text: Column) -> Column:
    return first_match(text, KIND_WORDS, F.lit("apartment"))


def rooms_of(kind: Column, bedrooms: Column) -> Column:
    """A bedroom count leaves out the living room."""
    return F.coalesce(first_match(F.lower(F.coalesce(kind, F.lit(""))), [(n, t) for t, n in ROOMS_BY_KIND]), bedrooms + 1)


def at_least_none(n: Column) -> Column:
    """n, or 0 if it is negative; null stays null, which greatest() would not keep."""
    return F.when(n < 0, F.lit(0)).otherwise(n)


def bedrooms_of(title: Column, body: Column) -> Column:
    """From titles and text: digits, written-out rooms, room digits, studios; in this order, titles first."""
    digit = lambda pattern: F.coalesce(*(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("int") for x in (title, body)))
    written = first_match(F.concat_ws("\n", title, body), [(max(n - 1, 0), p) for n, p in ROOM_WORDS])
    by_digit = digit(ROOMS_DIGIT) - 1
    studio = F.when(title.rlike(STUDIO) | F.left(body, F.lit(400)).rlike(STUDIO), F.lit(0))
    return F.coalesce(digit(BEDROOMS), written, at_least_none(by_digit), studio)


def deal_of(text: Column) -> Column:
    return F.when(text.rlike(RENT), "rent").otherwise("sale")


def is_sold(text: Column) -> Column:
    return F.coalesce(text.rlike(SOLD), F.lit(False))


def floor_number(text: Column) -> Column:
    """A whole text that names a floor: 'third floor' -> 3, 'minus third floor' -> -3, '7th floor' -> 7, 'ground' -> 0."""
    low = F.lower(F.trim(text))
    at = F.array_position(F.array(*map(F.lit, ORDINALS)), F.regexp_extract(low, r"^(?:minus )?([a-z]+) floor$", 1))
    named = F.when(at > 0, F.when(low.startswith("minus "), -at).otherwise(at))
    digits = F.nullif(F.regexp_extract(low, r"^(-?\d+)(?:st|nd|rd|th)? floor$", 1), F.lit("")).try_cast("int")
    digits = F.when(digits.between(LOWEST_FLOOR, HIGHEST_FLOOR), digits)
    return F.when(low.isin("ground", "ground floor"), F.lit(0)).otherwise(F.coalesce(named, digits)).cast("int")


def kind_and_rooms(text: Column) -> Column:
    """struct(kind, rooms) by the second taxonomy; rooms count all rooms, and what is not known keeps its first 40 letters."""
    low = F.lower(text)
    digit = F.nullif(F.regexp_extract(low, r"(?<!\d)([1-9])\s*[- ]?\s*стаен", 1), F.lit("")).try_cast("int")
    rooms = F.coalesce(first_match(low, [(n, t) for t, n in NAMED_ROOMS]), digit)
    names = F.create_map(*(F.lit(x) for pair in ROOM_NAMES.items() for x in pair))
    other = first_match(low, OTHER_KINDS)
    kind = F.when(rooms.isNotNull(), F.coalesce(F.try_element_at(names, rooms), F.lit(MANY_ROOMS))).otherwise(F.coalesce(other, F.left(text, F.lit(40))))
    return F.struct(kind.alias("kind"), F.coalesce(rooms, F.when(other == "Студио", F.lit(1))).alias("rooms"))


def pet_fact(text: Column) -> Column:
    """The first statement about pets, as it stands; '' without one."""
    return F.coalesce(F.regexp_extract(text, PET_FACT, 1), F.lit(""))


def completeness(missing: Column) -> Column:
    return F.when(F.size(missing) == 0, "full").when(F.size(missing) <= 2, "partial").otherwise("thin")
