"""Tolerant field equality: surrounding white space, case and numeric spelling do not count."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white-space character of Unicode as the standard str.strip() knows it.
WHITE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())

#: Spellings of a finite number or infinity. NaN is left out: it equals nothing, as text that is no number does.
NUMBER = (
    r"^[+-]?(?i:inf|infinity|(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:e[+-]?[0-9]+(?:_[0-9]+)*)?)$"
)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def as_number(c: Column) -> Column:
    """Double, or null if the text does not spell a number."""
    t = trimmed(c)
    return F.when(t.rlike(NUMBER), F.regexp_replace(t, "_", "").try_cast("double"))


def differs(a: Column, b: Column) -> Column:
    """True where two texts (not null) are unlike. The exact test comes first, so equal cells cost one comparison."""
    return (a != b) & (F.lower(trimmed(a)) != F.lower(trimmed(b))) & ~F.coalesce(as_number(a) == as_number(b), F.lit(False))
