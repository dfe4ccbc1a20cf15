"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

A value's digits and letters are one number in a mixed radix; a keyed Feistel network permutes that domain. A value
maps to the same pseudonym in every document and in every way of writing its separators, the map can be undone with
the key, and pseudonyms pass the same validation as the values (check digits, calendar dates, octets).

Dates are permuted as days, in every form by one map. It keeps whether the day of the month is over 12, which is what
tells a written day from a month, so a pseudonym reads in the order in which it was written. Days and months come out
with two digits. A number found beside other digits ("4111 1111 1111 1111 123") gets the pseudonym it has elsewhere;
should that and the digits beside it happen to be valid together, the key does not turn it back there."""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS, TOKEN_BLOCK = 8, 128


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: Feistel rounds over two halves of bits, walked until back in the domain."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            word = b if not back else a
            f = int.from_bytes(hashlib.blake2b(f"{tweak}:{size}:{i}:{word}".encode(), key=key, digest_size=32).digest(), "big") & mask
            a, b = (b, a ^ f) if not back else (b ^ f, a)
        value = a << half | b
        if value < size:
            return value


_SETS = {**{c: "0123456789" for c in "0123456789"}, **{c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}


def permute_text(value: str, key: bytes, tweak: str, sets: dict[str, str] = _SETS, back: bool = False, good: Callable[[str], bool] = lambda x: True) -> str:
    """Permutes what has a set of characters, among texts of the same format; walks on until the result is good."""
    while True:
        number, size = 0, 1
        for c in value:
            if c in sets:
                number, size = number * len(sets[c]) + sets[c].index(c), size * len(sets[c])
        number = permute(number, size, key, f"{tweak}:{''.join(sets[c][0] if c in sets else '-' for c in value)}", back)
        out = []
        for c in reversed(value):
            if c in sets:
                number, r = divmod(number, len(sets[c]))
                out.append(sets[c][r])
            else:
                out.append(c)
        value = "".join(reversed(out))
        if good(value):
            return value


def refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), form)


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(text: str, key: bytes, back: bool) -> str | None:
    d = digits_of(text)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    own = permute_text(d[1:-1], key, f"card{d[0]}", back=back)
    return refill(text, d[0] + own + luhn_digit(d[0] + own))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    flat = text.replace(" ", "")
    as_number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or as_number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = permute_text(flat[4:], key, f"iban{flat[:2]}", back=back)
    it = iter(flat[:2] + f"{98 - as_number(body + flat[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(it) for c in text)


def _nanp(d: str) -> bool:
    return d[0] in "23456789" and d[3] in "23456789" and d[1:3] != "11"


def _phone(text: str, key: bytes, back: bool) -> str | None:
    d = digits_of(text)
    plus = text.startswith("+")
    if len(d) == 11 and d[0] == "1" and _nanp(d[1:]):
        return refill(text, "1" + permute_text(d[1:], key, "nanp", back=back, good=_nanp))
    if len(d) == 10 and not plus and _nanp(d):
        return refill(text, permute_text(d, key, "nanp", back=back, good=_nanp))
    if plus and 8 <= len(d) <= 15 and d[0] in "23456789":
        return refill(text, d[:2] + permute_text(d[2:], key, f"e164{d[:2]}", back=back))
    return None


def _good_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    d = digits_of(text)
    return refill(text, permute_text(d, key, "ssn", back=back, good=_good_ssn)) if _good_ssn(d) else None


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in parts) or parts[0] in ("0", "127"):
        return None
    n = int.from_bytes(bytes(map(int, parts)), "big")
    while True:
        n = permute(n, 1 << 32, key, "ip", back)
        if n >> 24 not in (0, 127):
            return ".".join(map(str, n.to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(text: str, key: bytes, back: bool) -> str | None:
    a, mark, b, _, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", text).groups()
    year_first = len(a) == 4
    orders = [(a, b, c)] if year_first else [(c, b, a), (c, a, b)] if mark != "/" else [(c, a, b), (c, b, a)]
    for k, (y, m, d) in enumerate(orders):
        try:
            old = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        day = old.toordinal()
        if not _FIRST <= day <= _LAST:
            return None
        while True:
            day = _FIRST + permute(day - _FIRST, _LAST - _FIRST + 1, key, "date", back)
            new = datetime.date.fromordinal(day)
            if (new.day > 12) == (old.day > 12):
                break
        parts = {"y": f"{new.year}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        form = "ymd" if year_first else "dmy" if (mark != "/") == (k == 0) else "mdy"
        return mark.join(parts[x] for x in form)
    return None


def _email(text: str, key: bytes, back: bool) -> str | None:
    name, _, host = text.rpartition("@")
    labels = host.split(".")
    return f"{permute_text(name, key, 'name', back=back)}@{permute_text('.'.join(labels[:-1]), key, 'host', back=back)}.{labels[-1]}"


def _token(text: str, key: bytes, back: bool) -> str | None:
    """Secrets of any length, permuted in blocks of TOKEN_BLOCK characters behind a prefix that names the issuer."""
    if not re.search(r"[0-9]", text):
        return None
    if issuer := re.match(r"gh[pousr]_|sk-", text):
        rest = text[issuer.end() :]
        return issuer[0] + (_token(rest, key, back) or rest)
    sets = _HEX if re.fullmatch(r"[0-9a-f]+", text) else _SETS
    blocks = range(0, len(text), TOKEN_BLOCK)
    return "".join(permute_text(text[at : at + TOKEN_BLOCK], key, f"token{at or ''}", sets, back) for at in blocks)


def _key_id(text: str, key: bytes, back: bool) -> str | None:
    return text[:4] + permute_text(text[4:], key, "key id", back=back)


#: Kinds in order of precedence: name, pattern (the value is group 1 if it has one), pseudonym or None if not valid.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9-])")
_NUMERIC = (
    ("secret", re.compile(r"(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/-]{8,})"), _token),
    ("secret", re.compile(r"(?<![A-Za-z0-9])([0-9a-f]{32,}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"), _token),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"), _key_id),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"), _iban),
    ("ip", re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"), _ip),
    ("date", re.compile(r"(?<![\w./-])(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?![\w/-]|\.\d)"), _date),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"), _ssn),
    ("card", re.compile(r"(?<![\w-])(\d(?:[ -]?\d){12,18})(?![\w-])"), _card),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"), _phone),
)
_DIGIT = re.compile(r"[0-9]")
Span = tuple[str, int, int, str]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pseudonym", T.StringType())]))


#: Groups of digits by which cards are written.
_CARD_FORMS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4))


def _runs(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """What a match may be, as (start, end): all of it; for cards, runs of its groups in a card's form, or one group; for
    IBANs, its first groups. Longer runs first, so that a number is found beside others."""
    yield 0, len(text)
    cuts = [m.span() for m in re.finditer(r"[^ -]+", text)]
    n = len(cuts)
    if kind == "iban":
        for j in range(n - 1, 0, -1):
            yield 0, cuts[j - 1][1]
    if kind == "card":
        sizes = tuple(b - a for a, b in cuts)
        for size in range(n - 1, 0, -1):
            for i in range(n - size + 1):
                if sizes[i : i + size] in _CARD_FORMS or size == 1 and 13 <= sizes[i] <= 19:
                    yield cuts[i][0], cuts[i + size - 1][1]


def find_and_replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[Span]]:
    """The text with its values replaced, and (kind, start, end, pseudonym) for each, by start in the given text."""
    found: list[Span] = []
    taken: list[tuple[int, int]] = []  # sorted, without overlap

    def free(a: int, b: int) -> bool:
        at = bisect_left(taken, (a, a))
        return (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b)

    def look(kind: str, pattern: re.Pattern, make: Callable) -> None:
        for m in pattern.finditer(text):
            a = m.start(1)
            for x, y in _runs(kind, m[1]):
                if free(a + x, a + y) and (new := make(m[1][x:y], key, back)) is not None:
                    found.append((kind, a + x, a + y, new))
                    insort(taken, (a + x, a + y))
                    break

    if "@" in text:
        look("email", _EMAIL, _email)
    if _DIGIT.search(text) or "AKIA" in text:
        for kind, pattern, make in _NUMERIC:
            look(kind, pattern, make)
    found.sort(key=lambda x: x[1])
    out, at = [], 0
    for _, a, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with the values in text_col replaced, and one more column, pii_spans: array of (kind, start, end, pseudonym) by
    code points of the given text (a clashing column of docs is replaced).

    The row set and all other columns stay. A null text stays null, without spans; texts without values stay as they
    are; whole texts are searched, of any length. Nothing is shuffled. An empty table gives no rows. With back=True the
    same key turns pseudonyms into the values."""
    docs = docs.drop("pii_spans")

    place = docs.columns.index(text_col)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if x is None else find_and_replace(x, key, back) for x in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array([x[0] for x in done], pa.string())
            spans = pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), s, strict=True)) for s in x[1]] for x in done], spans_type)
            yield pa.RecordBatch.from_arrays([*columns, spans], [*batch.schema.names, "pii_spans"])

    schema = T.StructType([*docs.schema.fields, T.StructField("pii_spans", SPANS)])
    return docs.mapInArrow(run, schema)


def counts_by_kind(spans: str = "pii_spans"):
    """A Column: 'kind:n' of each kind found, sorted, joined by commas."""
    kinds = F.transform(F.col(spans), lambda s: s["kind"])
    return F.array_join(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.concat(k, F.lit(":"), F.size(F.filter(kinds, lambda x: x == k)).cast("string"))), ",")
