"""Identifiers and labels as delivered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is removed at either end of an identifier.
WHITE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """c without white space at either end; null stays null."""
    return F.btrim(c, F.lit(WHITE))


def clean_id(c: Column) -> Column:
    """The identifier in c, or null where there is none (null or blank). Case counts."""
    return F.nullif(strip(c), F.lit(""))


def clean_name(c: Column) -> Column:
    """A name that compares in any case: trimmed, lower case, null where blank."""
    return F.lower(clean_id(c))
