"""The rules of the timestamp operator once more, row by row with datetime and zoneinfo."""

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4}


def _day(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def _date_part(s):
    if m := re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", s):
        return _day(m[1], m[3], m[4])
    if m := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d\d)", s):
        y = m[4] if len(m[4]) == 4 else "20" + m[4]
        return _day(y, m[1], m[3]) if int(m[3]) > 12 else _day(y, m[3], m[1])
    for pattern, i, j, k in ((r"(\d{1,2})[ -]([A-Za-z]+)\.?[ -](\d{4})", 3, 2, 1), (r"([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})", 3, 1, 2)):
        if m := re.fullmatch(pattern, s):
            for n, name in enumerate(NAMES, 1):
                if m[j].lower() in (name, name[:3]):
                    return _day(m[i], n, m[k])
    return None


def plain(value, zone):
    """The one form of value, or None. zone: the source's zone or None."""
    if value is None or not (s := value.strip(" \t\n\r\x0b\x0c")):
        return None
    if s.isdigit():
        if len(s) == 8:
            d = _day(s[:4], s[4:6], s[6:])
            return d and d.isoformat()
        if len(s) not in (10, 13, 16):
            return None
        return (datetime(1970, 1, 1) + timedelta(microseconds=int(s.ljust(16, "0")))).isoformat(timespec="microseconds") + "Z"
    s = re.sub(r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "", s, flags=re.I)
    if d := _date_part(s):
        return d.isoformat()
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)?(.*)", s):
        s = f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6] or '00'}{m[7]}"
    m = re.fullmatch(r"(.*?)(?:T|,?\s+)(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?:\s*([AP])M)?(?:\s*(Z|[+-]\d\d:?(?:\d\d)?)|\s*\[(.*)\]|\s+(\S+))?", s, flags=re.I)
    d = m and _date_part(m[1])
    if not d:
        return None
    hour, minute, second = int(m[2]), int(m[3]), int(m[4] or 0)
    if m[6]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (m[6].lower() == "p")
    if hour > 23 or minute > 59 or second > 59:
        return None
    local = datetime(d.year, d.month, d.day, hour, minute, second, int((m[5] or "0")[:6].ljust(6, "0")))
    named = m[8] or m[9]
    if m[7] and m[7].upper() != "Z":
        o = m[7].replace(":", "")
        utc = local - (1 if o[0] == "+" else -1) * timedelta(hours=int(o[1:3]), minutes=int(o[3:] or 0))
    elif m[7] or (named and named.upper() in SHORT):
        utc = local - timedelta(hours=SHORT[(m[7] or named).upper()])
    else:
        try:
            tz = ZoneInfo(named or zone or "UTC")
        except Exception:
            return None
        utc = local.replace(tzinfo=tz, fold=0).astimezone(timezone.utc).replace(tzinfo=None)
    return utc.isoformat(timespec="microseconds") + "Z"
