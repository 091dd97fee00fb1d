"""Column expressions over whole texts that several operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def whole(text: str | Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column, between: str = SPACE) -> Column:
    """Array of words, in order; ``between`` is the pattern of what separates them."""
    return F.array_remove(F.split(whole(text), between), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change É or İ)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def unit(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the parts alone, with 52 random bits."""
    high = F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double")
    return (high + 0.5) / float(2**52)
