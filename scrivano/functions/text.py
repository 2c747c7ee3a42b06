"""Text functions as Column builders. Each tokenizer and splitter has its own definition; none stands in for another."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivano import constants as C


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it and whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    """Runs of letters, digits, underscores and apostrophes, Unicode-aware."""
    return _all(text, C.WORD)


def typo_tokens(text: Column) -> Column:
    """4 to 14 lower-case ASCII letters or apostrophes, with no boundaries: a run of 20 gives 14 and 6."""
    return _all(text, C.TYPO_TOKEN)


def latin_words(text: Column) -> Column:
    return _all(F.lower(text), C.LATIN_WORD)


def register_words(text: Column) -> Column:
    """ASCII letters and apostrophes of the lower-cased text."""
    return _all(F.lower(text), C.REGISTER_WORD)


def _members(ranges: str) -> str:
    """The characters of a class that is written as ranges."""
    found = re.findall(r"\\x\{([0-9a-f]+)\}(?:-\\x\{([0-9a-f]+)\})?", ranges)
    return "".join(chr(i) for a, b in found for i in range(int(a, 16), int(b or a, 16) + 1))


def js_trim(text: Column) -> Column:
    return F.trim(text, F.lit(_members(C.JS_WS)))


def py_strip(text: Column) -> Column:
    return F.trim(text, F.lit(_members(C.PY_WS)))


def sentences(text: Column) -> Column:
    """Blank lines and . ! ? end a sentence, single line feeds are spaces; trimmed, without empty ones."""
    flat = F.regexp_replace(F.regexp_replace(text, rf"\n[{C.JS_WS}]*\n", "¶"), "\n", " ")
    return F.filter(F.transform(F.split(flat, "[.!?¶]+"), js_trim), lambda s: F.length(s) > 0)


def register_sentences(text: Column) -> Column:
    """The register scorer's fragments: a line feed ends one as well; blank ones are left out."""
    return F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.length(js_trim(s)) > 0)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, untrimmed, without blank ones."""
    return F.filter(F.split(text, rf"\n[{C.JS_WS}]*\n"), lambda p: F.length(js_trim(p)) > 0)


def py_split(text: Column) -> Column:
    """The parts between white space, as str.split() gives them."""
    return F.filter(F.split(text, f"[{C.PY_WS}]+"), lambda s: F.length(s) > 0)


def py_word_count(text: Column) -> Column:
    """Runs without white space: the parts between single spaces, once all white space is such, that aren't empty.

    No match is made for each word, which a count by a pattern would do.
    """
    blanks = _members(C.PY_WS)
    return F.array_size(F.array_remove(F.split(F.translate(text, blanks, " " * len(blanks)), " "), ""))


def has_long_token(line: Column) -> Column:
    """Whether 40 characters follow each other without white space.

    Only a line with so long a part between spaces is searched. Such a run begins at the start or after white space, so it
    is tried after what is no printable ASCII alone.
    """
    return F.exists(F.split(line, " "), lambda part: F.length(part) >= 40) & line.rlike(rf"(?:^|[^\x21-\x7e])(?=\S{{40}}){C.LONG_TOKEN}")


def splitlines(text: Column) -> Column:
    """The lines as str.splitlines() gives them: no empty one after a last boundary."""
    return let(F.split(text, C.LINE_END), lambda parts: F.slice(parts, 1, F.size(parts) - (F.element_at(parts, -1) == "").cast("int")))


def occurrences(text: Column, part: str) -> Column:
    """How often a part occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def is_upper(word: Column) -> Column:
    return (word != F.lower(word)) & (word == F.upper(word))


def first_is_lower(text: Column) -> Column:
    """Whether the first character is a cased, lower one."""
    c = F.substring(text, 1, 1)
    return (F.length(c) > 0) & (c == F.lower(c)) & (c != F.upper(c))


def contractions(text: Column) -> Column:
    return _count(text, C.CONTRACTION)


def ellipses(text: Column) -> Column:
    return _count(text, C.ELLIPSIS)


def emoji(text: Column) -> Column:
    return _count(text, C.EMOJI)


def url_strip(text: Column) -> Column:
    return F.regexp_replace(text, C.URL, " ")


def demojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 put right; unchanged where the text isn't such."""
    narrow = ~text.rlike(r"[^\x00-\xFF]")
    decoded = F.try_validate_utf8(F.encode(F.when(narrow, text).otherwise(""), "ISO-8859-1").cast("string"))
    return let(decoded, lambda d: F.when(narrow & ~F.coalesce(d, F.lit("�")).contains("�"), d).otherwise(text))


def strip_machine_text(text: Column) -> Column:
    """Without code fences, image notes, log lines and lines with a token of 40 or more characters."""
    kept = F.filter(splitlines(F.regexp_replace(F.regexp_replace(text, C.FENCE, " "), C.IMAGE, " ")), lambda x: ~x.rlike(C.LOG_LINE) & ~has_long_token(x))
    return py_strip(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]+", " "))


def keep(raw: Column) -> Column:
    """A typed message without paste marks, trimmed; null where it is empty, a command, a notice or a wrapper."""
    t = js_trim(F.regexp_replace(raw, C.PASTE, ""))
    drop = (t == "") | (t == "+") | t.startswith("/") | t.startswith("Caveat:") | t.startswith("[Request interrupted") | (t.startswith("<") & t.contains(">"))
    return F.when(~drop, t)


def source_name(stem: Column) -> Column:
    """The platform that an archive's name begins with, else the name."""
    name = stem
    for p in reversed(C.PLATFORMS):
        name = F.when(F.lower(stem).startswith(p), p).otherwise(name)
    return name


def project_name(folder: Column) -> Column:
    return F.element_at(F.split(folder, "-projects-"), -1)


def stem(name: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
