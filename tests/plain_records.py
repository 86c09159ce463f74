"""The rules for delivered lines once more, character by character."""

import math
import re
from datetime import date


def fields_of(line, sep):
    """The fields, or None where the quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, text = i + 1, ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                text += line[i:j]
                if line[j + 1 : j + 2] == '"':
                    text, i = text + '"', j + 2
                    continue
                i = j + 1
                break
            if i < n and not line.startswith(sep, i):
                return None
        else:
            j = line.find(sep, i)
            text = line[i:] if j < 0 else line[i:j]
            if '"' in text:
                return None
            i += len(text)
        out.append(text.strip(" \t\r\n\x0b\x0c"))
        if i >= n:
            return out
        i += len(sep)


def is_day(s):
    m = re.fullmatch(r"(\d{4})([-/])(\d\d?)\2(\d\d?)", s, re.A)
    y, mo, d = (m[1], m[3], m[4]) if m else (None, None, None)
    if not m and (m := re.fullmatch(r"(\d\d?)([-/])(\d\d?)\2(\d{4})", s, re.A)):
        d, mo, y = m[1], m[3], m[4]
    try:
        return bool(m) and bool(date(int(y), int(mo), int(d)))
    except ValueError:
        return False


def is_distance(s):
    return bool(re.fullmatch(r"\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s, re.A)) and math.isfinite(float(s))


def reasons(rows):
    """rows: dicts of raw_records. {record_id: reason} of those that cannot be loaded."""
    cut = lambda r: r["line"].removesuffix("\r")
    head = {r["file_name"]: fields_of(cut(r), r["sep"]) for r in rows if r["line_no"] == 1}
    out = {}
    for r in rows:
        if r["line_no"] == 1 or not cut(r).strip(" "):
            continue
        h, f = head[r["file_name"]], fields_of(cut(r), r["sep"])
        if f is None:
            out[r["record_id"]] = "quoting"
        elif len(f) != len(h):
            out[r["record_id"]] = "columns"
        elif r["file_kind"] == "kp_snp_matrix":
            if not f[0] or f[0] not in h[1:]:
                out[r["record_id"]] = "id"
            elif not all(map(is_distance, f[1:])):
                out[r["record_id"]] = "value"
        else:
            names = [x.lower() for x in h]
            if not f[names.index("isolate_id")]:
                out[r["record_id"]] = "id"
            elif not is_day(f[names.index("collection_date")]):
                out[r["record_id"]] = "value"
    return out
