"""Canonical forms of the keys that arrive written in several ways.

Every function takes a column (or its name) and returns a Catalyst expression, so
that filters, projections and code generation see through it. A value without a
usable key gives null, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_ROOT = "/srv/scanstore"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest(x: Column | str) -> Column:
    """The 64 hex digits of an unbroken run of exactly that length, in lower case; null if there is none."""
    found = F.regexp_extract(_c(x), r"(?<![0-9a-fA-F])([0-9a-fA-F]{64})(?![0-9a-fA-F])", 1)
    return F.lower(F.nullif(found, F.lit("")))


def document_key(x: Column | str) -> Column:
    """A document id without case, separators, wrapping and blanks; '' if nothing is left, null for null.

    >>> "{03C7E141-...}", "urn:uuid:03c7e141-..." and "03c7e141..." share one key.
    """
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^0-9a-z]", ""), r"^urnuuid", "")


def is_given(x: Column | str) -> Column:
    """Neither null nor blank (white space of any kind)."""
    return F.coalesce(F.regexp_replace(_c(x), r"\s", "") != "", F.lit(False))


def hash64(x: Column | str) -> Column:
    """A 64-bit number written in hex ('0x' and leading zeros optional) as a bigint with the same bits."""
    text = F.lower(F.regexp_replace(_c(x), r"^\s+|\s+$", ""))
    bare = F.regexp_extract(text, r"^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    full = F.lpad(bare, 16, "0")
    high = F.conv(F.substring(full, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(full, 9, 8), 16, 10).cast("bigint")
    return F.when(bare != "", F.shiftleft(high, 32).bitwiseOR(low))


def file_path(x: Column | str, root: str = STORE_ROOT) -> Column:
    """The absolute path that a spelling of a path resolves to; null for null and blank.

    Outer white space is dropped, backslashes are slashes, percent escapes count in
    ``file:`` URLs only, relative paths start at ``root``; empty and ``.`` segments
    vanish and ``..`` takes back one segment. Paths that are plain already skip the fold.
    """
    return F.when(_c(x).rlike(r"^(/(?!\.{1,2}(/|$))[^/\\\s]+)+$"), _c(x)).otherwise(_let(F.translate(F.regexp_replace(_c(x), r"^\s+|\s+$", ""), "\\", "/"), lambda raw: _resolved(raw, root)))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _resolved(raw: Column, root: str) -> Column:
    url = F.regexp_replace(raw, r"(?i)^file:(//(localhost)?(?=/))?", "")
    local = F.when(F.lower(F.substring(raw, 1, 5)) == "file:", F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)).otherwise(raw)
    absolute = _let(local, lambda path: F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), path)))
    folded = F.aggregate(
        F.split(absolute, "/"),
        F.lit(""),
        lambda path, part: F.when((part == "") | (part == "."), path)
        .when(part == "..", F.regexp_replace(path, r"/[^/]*$", ""))
        .otherwise(F.concat(path, F.lit("/"), part)),
    )
    return F.when(raw != "", folded)


def width_height(x: Column | str) -> tuple[Column, Column]:
    """Width and height out of '2480x3508', '(1654, 2339)', 'w=..;h=..' and the like; null unless both are plain numbers."""
    pattern = r"^[^0-9\-]*([0-9]{1,9})[^0-9\-]+([0-9]{1,9})[^0-9\-]*$"
    part = lambda i: F.nullif(F.regexp_extract(_c(x), pattern, i), F.lit("")).cast("bigint")
    return part(1), part(2)
