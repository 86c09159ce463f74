"""Mixed timestamp notations, precisions and zones, brought to one form.

A cascade of anchored patterns, each turning a value into the same fields (year, month, day, hour, minute, second,
fraction, half of the day, zone). The first pattern that matches decides; its fields are then checked strictly. The zone
is the value's own or the default that a lookup gives for the row's source. Local times follow one policy: one that
occurs twice is its first occurrence, one that is skipped is read with the offset valid before the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_name, strip

# Month names and the abbreviations with their offsets in minutes.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240}

_SEP = "\u0001"
_MONTH = "(?i:(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + r"))\.?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|z|[+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\])?|\s*\[([^\]]+)\]|\s+\(?([A-Za-z][A-Za-z0-9_+/-]*)\)?)?"
_REST = rf"(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?"

#: (name, anchored pattern, year, month, day) in the order in which they are tried; the last three are group numbers.
#: All patterns go on with the same eight groups: hour, minute, second, fraction, half, offset, bracketed zone, zone.
CASCADE: list[tuple[str, str, int, int, int]] = [
    ("year first", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_REST}$", 1, 3, 4),
    ("year last", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_REST}$", 4, 3, 1),
    ("basic", rf"^(\d{{4}})()(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?(){_ZONE}$", 1, 3, 4),
    ("day, month name", rf"^(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(\d{{1,2}})([ -]){_MONTH}[ -](\d{{4}}){_REST}$", 4, 3, 1),
    ("month name, day", rf"^(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?()(){_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}){_REST}$", 5, 3, 4),
]


def _fields(v: Column) -> Column:
    """The fields of the first pattern that matches: array of year, month, day, ..., name of the pattern; else null."""
    out = F.lit(None)
    for name, pattern, *ymd in reversed(CASCADE):
        first = 6 if name == "month name, day" else 5
        groups = [*ymd, *range(first, first + 8)]
        parts = F.split(F.regexp_replace(v, pattern, _SEP.join(f"${g}" for g in groups)), _SEP, -1)
        out = F.when(v.rlike(pattern), F.concat(parts, F.array(F.lit(name)))).otherwise(out)
    return out


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month_number(text: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(text, 1, 3))).cast("int")
    return F.when(text.rlike("^[0-9]+$"), _int(text)).otherwise(F.nullif(at, F.lit(0)))


def _valid_zone(name: Column) -> Column:
    """Whether name is a region of the time zone database (a strict parse gives null where it isn't)."""
    return name.rlike("^[A-Za-z_]+(/[A-Za-z0-9_+-]+)*$") & F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), name), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull()


def _micros_text(us: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of microseconds since 1970, whatever the session's zone."""
    day_us = 86_400_000_000
    rest = F.pmod(us, F.lit(day_us))
    day = F.call_function("div", us - rest, F.lit(day_us)).cast("int")
    part = lambda unit, of, n: F.lpad((F.call_function("div", rest, F.lit(unit)) % of).cast("string"), n, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), part(3_600_000_000, 24, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2), F.lit("."), part(1, 1_000_000, 6), F.lit("Z"))


def _bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, evaluated once a row: a generator of one element keeps later uses and filters from being expanded into it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def normalise_timestamps(df: DataFrame, value: str, source: str, zones: DataFrame, zone_source: str = "facility", zone: str = "tz") -> DataFrame:
    """df with the columns `normalised` (null where the value cannot be read) and `pattern` (the one that matched).

    A calendar day gives yyyy-MM-dd, a time the UTC instant with microseconds, further digits cut off. zones gives the
    default zone of a source (names trimmed, any case; of repeated names the first zone); sources that are null,
    unknown or have no valid zone take UTC. Null, blank, and impossible values give null. df's own columns stay, but
    for `normalised` and `pattern`, which are replaced.
    """
    df = df.drop("normalised", "pattern")
    lookup = zones.select(clean_name(F.col(zone_source)).alias("__source"), strip(F.col(zone)).alias("__zone")).filter(F.col("__source").isNotNull() & _valid_zone(F.col("__zone"))).groupBy("__source").agg(F.min("__zone").alias("__zone"))
    v = F.col("__v")
    d = df.withColumn("__v", strip(F.col(value))).withColumn("__source", clean_name(F.col(source))).join(lookup, "__source", "left")
    digits = v.rlike("^[0-9]+$")
    n = F.length(v)
    d = _bind(d, "__f", F.when(~digits, _fields(v)))
    f = lambda i: F.nullif(F.get("__f", F.lit(i)), F.lit(""))
    year, month, day = _int(f(0)), _month_number(f(1)), _int(f(2))
    swap = (F.get("__f", F.lit(11)) == "year last") & (month > 12)
    year = F.when(F.length(f(0)) == 2, year + 2000).otherwise(year)
    d = _bind(d, "__ymd", F.when(digits & (n == 8), F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2))).when(F.col("__f").isNotNull(), F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day))))
    d = _bind(d, "__day", F.when(F.col("__ymd").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & ~F.col("__ymd").startswith("0000"), F.col("__ymd").try_cast("date")))
    hour, minute, second, half = _int(f(3)), _int(f(4)), F.coalesce(_int(f(5)), F.lit(0)), F.lower(f(7))
    hour = F.when(half.isNull(), hour).when((hour >= 1) & (hour <= 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    micro = F.coalesce(_int(F.rpad(F.substring(f(6), 1, 6), 6, "0")), F.lit(0))
    timed = f(3).isNotNull()
    good = (hour <= 23) & (minute <= 59) & (second <= 59)
    local = F.unix_date("__day").cast("bigint") * 86_400_000_000 + (hour * 3600 + minute * 60 + second).cast("bigint") * 1_000_000 + micro
    offset, named = F.upper(f(8)), F.coalesce(f(9), f(10))
    offset_named = named.rlike("^[+-][0-9]{2}(:?[0-9]{2})?$")
    offset = F.coalesce(offset, F.when(offset_named, named))
    digits_of = F.regexp_replace(offset, "[^0-9]", "")
    hh, mm = _int(F.substring(digits_of, 1, 2)), F.coalesce(_int(F.nullif(F.substring(digits_of, 3, 2), F.lit(""))), F.lit(0))
    minutes = F.when(offset == "Z", 0).when((hh <= 18) & (mm <= 59), F.when(offset.startswith("-"), -(hh * 60 + mm)).otherwise(hh * 60 + mm))
    short = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    minutes = F.when(offset.isNotNull(), minutes).otherwise(F.try_element_at(short, F.upper(named)))
    own = offset.isNotNull() | named.isNotNull()
    d = _bind(_bind(d, "__local", F.when(timed & good, local)), "__minutes", minutes)
    region = F.when(named.isNull(), F.coalesce("__zone", F.lit("UTC"))).when(_valid_zone(named), named)
    d = _bind(d, "__region", F.when(timed & F.col("__minutes").isNull() & offset.isNull(), region))
    # to_utc_timestamp resolves a wall-clock time by the stated policy; its argument holds the wall clock as if in UTC
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__local"), F.coalesce("__region", F.lit("UTC"))))
    instant = F.when(F.col("__minutes").isNotNull(), F.col("__local") - F.col("__minutes").cast("bigint") * 60_000_000).when(F.col("__region").isNotNull(), by_zone)
    epoch = F.when(digits & n.isin(10, 13, 16), F.rpad(v, 16, "0").try_cast("bigint"))
    d = _bind(d, "__us", F.when(epoch.isNotNull(), epoch).when(timed, F.when(own | F.col("__region").isNotNull(), instant)))
    d = _bind(d, "normalised", F.when(epoch.isNotNull() | timed, _micros_text(F.col("__us"))).otherwise(F.col("__day").cast("string")))
    pattern = F.when(F.col("__f").isNotNull(), F.get("__f", F.lit(11))).when(digits, "digits")
    return d.select(*df.columns, "normalised", F.when(F.col("normalised").isNotNull(), pattern).alias("pattern"))
