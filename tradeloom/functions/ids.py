"""Canonical forms of identifiers that sources spell differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower case, letters and digits only; null for null and for values without a letter or digit."""
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(s != "", s)


def member_id(c: Column) -> Column:
    """A letter and six digits: case, blanks, separators, dropped zeros and the letter O for zero are undone.

    Values of another shape keep their letters and digits in upper case; null and blank values give null.
    """
    s = F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", "")
    digits = F.replace(F.substring(s, 2, 99), F.lit("O"), F.lit("0"))
    shaped = F.concat(F.substring(s, 1, 1), F.lpad(digits, 6, "0"))
    return F.when(s.rlike(r"^[A-Z][0-9O]{1,6}$"), shaped).when(s != "", s)
