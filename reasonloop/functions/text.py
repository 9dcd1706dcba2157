"""Unicode-aware text helpers built from native Column functions.

Python's ``str.strip`` / ``str.splitlines`` / ``\\d`` are Unicode-aware while Java regex
and Spark ``trim`` are ASCII by default, so every pattern here runs in ``(?U)`` mode and
the whitespace class adds the separators U+001C..U+001F that Python also strips.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?U)"
# Python's str.isspace() set = Unicode White_Space plus U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"
# Python's str.splitlines() breaks: \R covers \r\n, \n, \x0b, \f, \r, \x85, \u2028, \u2029.
LINE_BREAK = r"(?U)\R|[\x1c-\x1e]"
_BREAKS = "\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"
ANY_BREAK = f"[{_BREAKS}]"


# Python's str.isspace() characters, by rule
_SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def trim_u(c: Column) -> Column:
    """Python ``str.strip()``: drop leading and trailing Unicode whitespace (linear in the text)."""
    return F.btrim(c, F.lit(_SPACE_CHARS))


def rstrip_dots(c: Column) -> Column:
    """Python ``str.rstrip('.')``."""
    return F.rtrim(c, F.lit("."))


def without(c: Column, part: str) -> Column:
    """``str.replace(part, '')``."""
    return F.replace(c, F.lit(part), F.lit(""))


def split_lines(c: Column) -> Column:
    """Python ``str.splitlines()`` pieces (a trailing empty piece may remain)."""
    return F.split(c, LINE_BREAK, -1)


def nonblank_lines(c: Column) -> Column:
    """``[l.strip() for l in s.splitlines() if l.strip()]`` as an array column."""
    return F.filter(F.transform(split_lines(c), trim_u), lambda x: x != F.lit(""))


def last_line(c: Column) -> Column:
    """Last line of the text, stripped ("" for an empty text)."""
    return trim_u(F.element_at(split_lines(c), -1))


def after_last_break(c: Column) -> Column:
    """:func:`last_line` without a regular expression; longer as a tree, so for a column of its own."""
    for b in _BREAKS:
        c = F.substring_index(c, b, -1)
    return trim_u(c)


@lru_cache(maxsize=1)
def _digit_map() -> tuple[str, str]:
    # Rule-built table: every Unicode decimal digit that is not ASCII maps to its value,
    # as Python's float() reads it.
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        d = unicodedata.decimal(ch, None)
        if d is not None:
            src.append(ch)
            dst.append(str(d))
    return "".join(src), "".join(dst)


def ascii_digits(c: Column) -> Column:
    """Map non-ASCII decimal digits to ASCII ones (parity with Python ``float``)."""
    src, dst = _digit_map()
    return F.translate(c, src, dst)
