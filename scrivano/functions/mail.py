"""Cleaning of mail bodies, addresses and dates."""

from __future__ import annotations

import datetime
import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivano import constants as C
from scrivano.functions import text as T

_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([a-zA-Z][a-zA-Z0-9]*);?)")
_CLOSED = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+))|([a-zA-Z][a-zA-Z0-9]*));")
_NAMED = {name: html.unescape(f"&{name};") for name in C.ENTITIES}
_DATE = re.compile(C.RFC5322)


def clean(text: Column) -> Column:
    """A body up to the signature and the first quoted message, without quoted lines and URLs."""
    marked = lambda x: x.rlike(C.QUOTE_INTRO) | x.rlike(C.OUTLOOK_DIVIDER)
    upto = lambda lines, cut: F.slice(lines, 1, F.when(cut > 0, cut - 1).otherwise(F.size(lines)))
    head = T.let(T.splitlines(F.substring_index(text, "\n-- \n", 1)), lambda lines: T.let(F.array_position(F.transform(lines, marked), F.lit(True)).cast("int"), lambda cut: upto(lines, cut)))
    own = F.filter(head, lambda x: ~x.rlike(f"^[{C.PY_WS}]*>"))
    joined = F.regexp_replace(T.url_strip(F.array_join(own, "\n")), r"[ \t]+", " ")
    return T.py_strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def is_bounce(text: Column) -> Column:
    return text.rlike(C.BOUNCE)


def from_address(value: Column) -> Column:
    low = F.lower(value)
    return T.js_trim(F.when(low.contains("<"), F.regexp_replace(F.substring_index(low, "<", -1), ">+$", "")).otherwise(low))


def year(ts: Column) -> Column:
    """The first token of exactly four digits; null without one."""
    found = F.regexp_extract(ts, f"(?<![^{C.JS_WS}])([0-9]{{4}})(?![^{C.JS_WS}])", 1)
    return F.when(found != "", found.cast("int"))


def markup_to_lines(markup: Column) -> Column:
    """Markup without scripts, styles and tags, with line feeds for breaks; references are still as they were."""
    text = F.regexp_replace(markup, r"(?is)<(style|script).*?</\1>", " ")
    text = F.regexp_replace(text, rf"(?i)<br[{C.JS_WS}]*/?>|</p>|</div>", "\n")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def _character(number: int) -> str:
    if 0x80 <= number <= 0x9F:  # as Windows-1252 has it
        try:
            return bytes([number]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(number)
    return "�" if number == 0 or 0xD800 <= number <= 0xDFFF or number > 0x10FFFF else chr(number)


def unescape_text(text: str, closed: bool = False) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return _character(int(m[1], 16) if m[1] else int(m[2]))
        return _NAMED.get(m[3], m[0])

    return (_CLOSED if closed else _REFERENCE).sub(one, text)


_XML = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def unescape_xml(text: str) -> str:
    """XML's five entities and numeric references, which need their semicolon; any other stays."""
    return re.sub(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|(lt|gt|amp|quot|apos));", lambda m: _XML[m[3]] if m[3] else _character(int(m[2], 16) if m[2] else int(m[1])), text)


def unescape(text: Column, closed: bool = False) -> Column:
    """Numeric and common named character references decoded; unknown names stay.

    Mail often lacks the semicolon, so it isn't needed; closed decodes only references that have theirs.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unescape_text(t, closed) if "&" in t else t for t in texts.to_pylist()], pa.string())

    return run(text)


def html_to_text(markup: Column, closed: bool = False) -> Column:
    return unescape(markup_to_lines(markup), closed)


def format_date_text(raw: str) -> str:
    """The date as mail headers write it; unchanged where it is none."""
    m = _DATE.match(raw)
    month = m and next((i for i, x in enumerate(C.MONTHS, 1) if x.lower() == m[2].lower()), None)
    if not month:
        return raw
    zone = m[7] if m[7][0] in "+-" else C.ZONES.get(m[7].lower())
    y = int(m[3]) + (0 if len(m[3]) > 2 else 2000 if int(m[3]) < 69 else 1900)
    try:
        when = datetime.datetime(y, month, int(m[1]), int(m[4]), int(m[5]), int(m[6] or 0))
    except ValueError:
        return raw
    return f"{C.WEEKDAYS[when.weekday()]}, {when.day:02} {C.MONTHS[month - 1]} {y} {when:%H:%M:%S} {zone}" if zone else raw


def format_date(raw: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format_date_text(v) for v in values.to_pylist()], pa.string())

    return run(raw)
