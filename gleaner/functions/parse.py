"""Filters, log formats, timestamps and time buckets, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"day": 86400, "hour": 3600, "minute": 60}
LABELS = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH", "minute": "yyyy-MM-dd HH:mm"}
DEFAULT_LABEL = "yyyy-MM-dd HH:mm:ss"
#: Layout words, the longest first where one begins another, and what Spark calls them.
LAYOUT = (
    ("January", "MMMM"), ("Jan", "MMM"), ("2006", "yyyy"), ("_2", "d"), ("01", "MM"), ("02", "dd"), ("03", "hh"),
    ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), (".000", ".SSS"), ("1", "M"), ("2", "d"),
)
#: Weekdays and zones are read over: wall-clock fields count.
SKIPPED = (
    ("Monday", r"\p{L}+day"), ("Mon", r"\p{L}{3}"), ("Z07:00", r"(?:Z|[+-]\d\d:\d\d)"), ("-07:00", r"[+-]\d\d:\d\d"),
    ("-0700", r"[+-]\d{4}"), ("-07", r"[+-]\d\d"), ("MST", r"[A-Z]{3,4}"),
)


def matches(line: Column, include=(), exclude=()) -> Column:
    """All include patterns are found and no exclude pattern is; empty patterns are left out."""
    out = F.lit(True)
    for p in include or ():
        out = out & line.rlike("(?d)" + p) if p else out
    for p in exclude or ():
        out = out & ~line.rlike("(?d)" + p) if p else out
    return out


def plain_groups(log_format: str) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups, and the number of each named group (of duplicates, the last)."""
    names, n, i = {}, 0, 0
    while i < len(log_format):
        c = log_format[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            end = i + 1 + (log_format[i + 1 : i + 2] == "^")
            end += log_format[end : end + 1] == "]"
            while log_format[end : end + 1] not in ("]", ""):
                end += 2 if log_format[end] == "\\" else 1
            i = end + 1
            continue
        if c == "(":
            m = re.match(r"\(\?P?<(\w+)>", log_format[i:])
            if m or log_format[i + 1 : i + 2] != "?":
                n += 1
            if m:
                names[m[1]] = n
        i += 1
    return "(?d)" + re.sub(r"\(\?P?<\w+>", "(", log_format), names


def java_layout(layout: str) -> tuple[str, str]:
    """(Spark's pattern, pattern of what to delete from the text first)."""
    out, skipped, i = [], [], 0
    while i < len(layout):
        for word, pattern in SKIPPED:
            if layout.startswith(word, i):
                skipped.append(pattern)
                i += len(word)
                break
        else:
            for word, java in LAYOUT:
                if layout.startswith(word, i):
                    out.append(java)
                    i += len(word)
                    break
            else:
                c = layout[i]
                out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
                i += 1
    return re.sub(r"\s+", " ", "".join(out)).strip().replace("''''", "''"), "|".join(skipped)


def epoch(text: Column, layout: str, now: Column) -> Column:
    """Unix seconds of a timestamp whose year is replaced: by now's, or the one before if its month is later.

    Null if the text doesn't fit. A 29 February in a common year is 1 March.
    """
    pattern, skipped = java_layout(layout)
    text = F.regexp_replace(text, skipped, "") if skipped else text
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    has_year = "y" in pattern
    parsed = (
        F.try_to_timestamp(text, F.lit(pattern))
        if has_year
        else F.try_to_timestamp(F.concat(F.lit("2000 "), text), F.lit("yyyy " + pattern))
    )
    year = F.year(now) - (F.month(now) < F.month(parsed)).cast("int")
    months = ((year - F.year(parsed)) * 12).cast("int")
    moved = parsed + F.make_interval(months=months)
    leap = (F.date_format(parsed, "MM-dd") == "02-29") & (F.dayofmonth(moved) == 28)
    return F.unix_timestamp(F.when(leap, moved + F.expr("interval 1 day")).otherwise(moved))


def retention_pos(at: Column, frequency: str) -> Column:
    """The number of the time bucket that a timestamp falls in; 0 without a known frequency."""
    day = F.year(at) * 1000 + F.dayofyear(at)
    hour = F.year(at) * 100000 + F.dayofyear(at) * 100 + F.hour(at)
    out = {"day": day, "hour": hour, "minute": hour * 100 + F.minute(at)}.get(frequency, F.lit(0))
    return out.cast("long")


def parsed(line: Column, log_format: str, layout: str, file_epoch: Column, now: Column) -> Column:
    """struct(epoch, message) of a line.

    A line that doesn't fit the format is its own message, at the file's time; so is the
    time of one whose timestamp can't be read.
    """
    if not log_format:
        return F.struct(file_epoch.cast("long").alias("epoch"), line.alias("message"))
    pattern, names = plain_groups(log_format)
    fits = line.rlike(pattern)
    at = F.lit(None).cast("long")
    if "timestamp" in names and layout:
        at = epoch(F.regexp_extract(line, pattern, names["timestamp"]), layout, now)
    message = F.regexp_extract(line, pattern, names["message"]) if "message" in names else line
    return F.struct(
        F.when(fits, F.coalesce(at, file_epoch.cast("long"))).otherwise(file_epoch.cast("long")).alias("epoch"),
        F.when(fits, message).otherwise(line).alias("message"),
    )
