"""Server-rendered component streams: length-delimited text and JSON records pushed by scripts, decoded per page.

Text records carry their length in bytes and may hold anything, also what looks like a record; so they are cut out by
length before records are read. That needs a scanner, not patterns: one Arrow UDF.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUSH = re.compile(r"self\.__next_f\.push\((\[.*?\])\)\s*(?:</script>|$)", re.S)
_TEXT = re.compile(rb"[0-9a-f]+:T([0-9a-f]+),")


class BrokenStream(ValueError):
    """A text record is longer than what was sent."""


def pushed(html: str) -> bytes:
    """The stream that a page's scripts push, in order."""
    parts = []
    for raw in PUSH.findall(html):
        try:
            value = json.loads(raw)
        except ValueError:
            continue
        if len(value) > 1 and isinstance(value[1], str):
            parts.append(value[1])
    return "".join(parts).encode()


def records(stream: bytes) -> list[dict]:
    """The properties of all component records: JSON arrays of four whose last is an object."""
    out, at, fresh = [], 0, True
    decoder = json.JSONDecoder()
    while at < len(stream):
        text = _TEXT.match(stream, at) if fresh else None
        if text:
            at = text.end() + int(text[1], 16)
            if at > len(stream):
                raise BrokenStream
            fresh = True  # the next record may follow without a line end
            continue
        head = re.compile(rb"[0-9a-f]+:").match(stream, at) if fresh else None
        if head and stream[head.end() : head.end() + 1] in (b"[", b"{"):
            rest = stream[head.end() :].decode("utf-8", "replace")
            try:
                item, used = decoder.raw_decode(rest)
            except ValueError:
                item, used = None, 0
            if isinstance(item, list) and len(item) == 4 and isinstance(item[3], dict):
                out.append(item[3])
            at = head.end() + len(rest[:used].encode())
            fresh = used > 0 and stream[at : at + 1] != b"\n"
            if used:
                continue
        line = stream.find(b"\n", at)
        if line < 0:
            break
        at, fresh = line + 1, True
    return out


def _read(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        rows = []
        for html in part:
            try:
                rows.append([json.dumps(r, ensure_ascii=False) for r in records(pushed(html or ""))])
            except BrokenStream:
                rows.append(None)
        yield pd.Series(rows)


def with_records(pages: DataFrame, html: str = "html", name: str = "records") -> DataFrame:
    """pages with an array of JSON objects; null where a stream is cut short."""
    read = F.pandas_udf(_read, "array<string>")
    return pages.withColumn(name, read(F.col(html)))
