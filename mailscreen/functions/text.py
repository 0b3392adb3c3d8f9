"""Text cleaning as Column expressions.

The character classes are spelled out because `\\s`, `\\w` and `\\b` mean different
things in Python and on the JVM; these follow Python's meaning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's white space, word and digit characters as class bodies.  ASCII
# comes first because the JVM tests such ranges with one table lookup.
SPACE = r"\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD_SPACE = f"[[^ -~]&&[{SPACE.replace(' ', '')}]]"  # all but the blank; ASCII text is ruled out at once
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
DIGIT = r"0-9\p{Nd}"

# What is removed or masked.
SCRIPT_BLOCK = r"(?isu)<(script|style).*?>.*?</\1>"
TAG = r"<[^>]+>"
URL = rf"(?=[HhWw])(?iu:https?://|www\.)[^{SPACE}]+"
URL_MARKS = ["://", "ww.", "wW.", "Ww.", "WW."]  # no text without one of them holds a URL
# \b[\w.+-]+@[\w-]+\.[\w.-]+\b, with the two edges written out: it starts with a word, or
# right behind one with a dot, plus or dash, and its last character is a word character.
ADDRESS = rf"(?:(?<![{WORD}])[{WORD}]|(?<=[{WORD}])[.+-])[{WORD}.+-]*+@[{WORD}-]+\.[{WORD}.-]*[{WORD}]"
URL_MASK = " URLTOKEN "
ADDRESS_MASK = " EMAILTOKEN "

# Fixed value: line breaks of Python's str.splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _column(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only_with(marks: list[str], text: Column, change: Callable[[Column], Column], rest: Callable[[Column], Column]) -> Column:
    """`change` of texts that hold one of the marks, `rest` of the others; looking for a mark is far cheaper than `change`."""

    def either(t: Column) -> Column:
        held = [F.contains(t, F.lit(mark)) for mark in marks]
        return F.when(reduce(or_, held), change(t)).otherwise(rest(t))

    return let(text, either)


def _only_with(marks: list[str], text: Column, change: Callable[[Column], Column]) -> Column:
    """Texts without any of the marks pass unchanged."""
    return only_with(marks, text, change, lambda t: t)


def strip_html(text: str | Column) -> Column:
    """Replace script/style blocks, then every remaining tag, by a blank."""

    def change(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, SCRIPT_BLOCK, " "), TAG, " ")

    return _only_with(["<"], _column(text), change)


def mask_urls(text: str | Column) -> Column:
    return _only_with(URL_MARKS, _column(text), lambda t: F.regexp_replace(t, URL, URL_MASK))


def url_hits(text: str | Column) -> Column:
    return only_with(URL_MARKS, _column(text), lambda t: F.regexp_count(t, F.lit(URL)), lambda t: F.lit(0))


def mask_addresses(text: str | Column) -> Column:
    return _only_with(["@"], _column(text), lambda t: F.regexp_replace(t, ADDRESS, ADDRESS_MASK))


def squeeze(text: str | Column) -> Column:
    """White-space runs become one blank; none is left at either end."""
    blanks = F.regexp_replace(_column(text), ODD_SPACE, " ")
    return F.trim(_only_with(["  "], blanks, lambda t: F.regexp_replace(t, " {2,}", " ")))


def strip(text: str | Column) -> Column:
    """Drop white space at both ends only."""
    return F.regexp_replace(_column(text), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_whitespace(text: str | Column) -> Column:
    """`squeeze`, then no blank in front of punctuation."""
    return F.regexp_replace(squeeze(text), " (?=[!?.,;:])", "")


def clean_text(text: str | Column) -> Column:
    """NUL, HTML, URLs, addresses, white space: in this order.  NULL gives ''."""
    no_nul = F.replace(F.coalesce(_column(text), F.lit("")), F.lit("\x00"), F.lit(" "))
    return normalize_whitespace(mask_addresses(mask_urls(strip_html(no_nul))))


def dedupe_key(text: str | Column) -> Column:
    """Texts with equal keys count as copies of each other."""
    return F.lower(clean_text(text))


def dedupe_hash(text: str | Column) -> Column:
    """The 64 hex digits that travel through shuffles in place of `dedupe_key`."""
    return F.sha2(dedupe_key(text), 256)


def preview(text: str | Column, longest: int, keep: int, one_line: bool = False) -> Column:
    """First `keep` characters and '...' where the text has more than `longest`."""
    value = _column(text)
    short = F.when(F.length(value) > longest, F.concat(F.substring(value, 1, keep), F.lit("..."))).otherwise(value)
    return F.replace(short, F.lit("\n"), F.lit(" ")) if one_line else short


def sample_preview(text: str | Column) -> Column:
    """Preview in sample listings: 100 characters."""
    return preview(text, 100, 100)


def served_preview(text: str | Column) -> Column:
    """Preview in scored rows: at most 140 characters, cut at 139."""
    return preview(text, 140, 139)


def report_preview(text: str | Column) -> Column:
    """Preview in reports: 180 characters on one line, no dots."""
    return F.replace(F.substring(_column(text), 1, 180), F.lit("\n"), F.lit(" "))


def error_preview(text: str | Column) -> Column:
    """Preview in error listings: 100 characters, no dots."""
    return F.substring(_column(text), 1, 100)
