"""Sequence types, days and names as the readers bring them to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strainweave.functions.ids import strip

# Spellings (lower case) of a type that is not known yet.
NOVEL = ["", "novel", "-", "–", "na", "nan"]


def sequence_type(c: Column) -> Column:
    """The type without a leading ST (any case); `novel` for the spellings of an unknown one; null stays null."""
    v = strip(c)
    bare = F.when(F.upper(v).startswith("ST"), strip(F.substring(v, F.lit(3), F.length(v)))).otherwise(v)
    return F.when(v.isNull(), None).when(F.lower(v).isin(NOVEL) | (bare == ""), "novel").otherwise(bare)


def _ymd(v: Column, pattern: str, order: str) -> Column:
    return F.when(v.rlike(pattern), F.regexp_replace(v, pattern, order).try_cast("date"))


def parse_day(c: Column) -> Column:
    """The day in c: yyyy-M-d, d/M/yyyy, d-M-yyyy or yyyy/M/d, then M/d/yyyy, then the day of an ISO timestamp; else null."""
    v = strip(c)
    a, b = r"([0-9]{4})", r"([0-9]{1,2})"
    return F.coalesce(
        _ymd(v, f"^{a}-{b}-{b}$", "$1-$2-$3"),
        _ymd(v, f"^{b}/{b}/{a}$", "$3-$2-$1"),
        _ymd(v, f"^{b}-{b}-{a}$", "$3-$2-$1"),
        _ymd(v, f"^{a}/{b}/{b}$", "$1-$2-$3"),
        _ymd(v, f"^{b}/{b}/{a}$", "$3-$1-$2"),
        _ymd(v, f"^{a}-{b}-{b}[T ][0-9]{{2}}:.*$", "$1-$2-$3"),
    )


def or_unknown(c: Column) -> Column:
    """c trimmed; `unknown` where null or blank."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("unknown"))
