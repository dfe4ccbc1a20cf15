"""Text functions as Column expressions: folding, romanisation, trigrams, hosts, path skeletons.

Java's patterns fold case and see letters beyond ASCII only with (?iu) and (?U); both are spelled out throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Romanisation. The first two tables are needed letter for letter.
MANY_LETTERS = {"щ": "sht", "ш": "sh", "ч": "ch", "ц": "ts", "ж": "zh", "ю": "yu", "я": "ya"}
ONE_LETTER = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ъ": "a",
    "ь": "y",
}
RUSSIAN = {"ы": "y", "э": "e", "ё": "e"}
# Words that say nothing about which building a title names.
TITLE_STOPWORDS = (
    "комплекс", "complex", "апартамент", "apartment", "резиденс", "residence", "квартира", "flat", "студио", "studio",
    "kompleks", "apartament", "rezidens", "kvartira",
)
# Cyrillic letters that look like Latin ones.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h"}


def _bases() -> dict[str, str]:
    """Letters with marks -> their base, for the Latin, Greek and Cyrillic blocks, by canonical decomposition."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFKD", c)
        if len(base) > 1 and all(map(unicodedata.combining, base[1:])):
            found[c] = base[0]
    return found


_BASES = _bases()


def lit_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it: inside lambdas and generators nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def translate(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def unaccent(text: Column) -> Column:
    """Strips marks: precomposed letters by table, loose combining marks by class."""
    return F.regexp_replace(translate(text, _BASES), r"\p{M}+", "")


def fold_part(text: Column) -> Column:
    """fold, but for outer white space: the fold of texts joined by spaces is that of their parts, joined and trimmed."""
    folded = F.replace(F.lower(unaccent(F.coalesce(text, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"(?U)[^\w\s]+", " ")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Lower case without marks, punctuation as spaces, outer white space gone. Null becomes ''."""
    return trimmed(fold_part(text))


def romanise(text: Column, russian: bool = True) -> Column:
    for letter, latin in MANY_LETTERS.items():
        text = F.replace(text, F.lit(letter), F.lit(latin))
    return translate(text, ONE_LETTER | (RUSSIAN if russian else {}))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def title_norm(title: Column) -> Column:
    """The folded, romanised title without stopwords and numbers."""
    kept = F.filter(words(romanise(fold(title))), lambda w: ~w.isin(*TITLE_STOPWORDS) & ~w.rlike(r"^\d+$"))
    return F.array_join(kept, " ")


def geo_norm(text: Column) -> Column:
    """Place names: lower, romanised, other characters as spaces, letters and digits apart. Marks are not stripped."""
    latin = romanise(F.lower(F.coalesce(text, F.lit(""))), russian=False)
    spaced = F.regexp_replace(latin, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(spaced, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """phrase in text at word borders; both normalised."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the words, each padded by two spaces before and one after."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(parts, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def undo_lookalikes(text: Column) -> Column:
    """In words that mix scripts, Cyrillic look-alikes become the Latin letters that they stand for; other words stay."""
    table = LOOKALIKES | {k.upper(): v.upper() for k, v in LOOKALIKES.items()}
    mixed = lambda w: w.rlike("[A-Za-z]") & w.rlike(r"\p{IsCyrillic}")
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(mixed(w), translate(w, table)).otherwise(w)), " ")


def is_distinctive(text: Column, generic: tuple[str, ...]) -> Column:
    """A word of four letters or more that is not generic."""
    return F.exists(words(fold(text)), lambda w: (F.length(w) >= 4) & ~w.isin(*generic))


def slugify(text: Column, limit: int = 70) -> Column:
    dashed = F.regexp_replace(romanise(F.lower(unaccent(text))), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(limit))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def registrable(url: Column) -> Column:
    return F.substring_index(host(url), ".", -2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def shape_of(url: Column) -> Column:
    """The path's first three segments with numbers, long and compound names as *."""
    star = lambda s: s.rlike(r"^\d+$") | (F.length(s) > 24) | s.rlike(r"\d{3,}") | (s.contains("-") & (F.length(s) > 12))
    parts = F.transform(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), lambda s: F.when(star(s), F.lit("*")).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 3), "/"))


def clean_url(url: Column) -> Column:
    """Repairs an address that repeats its scheme, and drops the fragment."""
    last = F.regexp_replace(F.trim(url), r"^https?:/{0,2}.*?(https?:/{1,2})", "$1")
    return F.substring_index(F.regexp_replace(last, r"^(https?):/+", "$1://"), "#", 1)


def try_int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def limited(text: Column, limit: int) -> Column:
    return F.left(F.trim(F.coalesce(text, F.lit(""))), F.lit(limit))
