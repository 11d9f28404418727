"""Typed conversion of the constants in queries, before any of them becomes a Spark literal.

Spark would cast or refuse a constant of another type than its column; here a constant is converted to the column's
type where it can be, and compared as a number or as text otherwise.
"""

from __future__ import annotations

import math
import re
from datetime import date, datetime, timedelta, timezone
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What numeric texts and instants look like.
NUMERIC = re.compile(r"\s*(?:[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|Infinity)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)?\s*")
INSTANT = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s?(Z|[+-]\d{2}:?\d{2})?)?")
EPOCH = datetime(1970, 1, 1)


def zone(name: str) -> ZoneInfo:
    if name == "local":
        return datetime.now().astimezone().tzinfo  # type: ignore[return-value]
    return ZoneInfo("UTC" if name.upper() in ("UTC", "Z", "GMT", "ETC/UTC") else name)


def to_utc(wall: datetime, tz: str) -> datetime:
    """The instant of a wall clock, as a naive UTC time: a skipped time moves forward, a repeated one is the earlier."""
    return wall.replace(tzinfo=zone(tz), fold=0).astimezone(timezone.utc).replace(tzinfo=None)


def number(value: Any) -> float:
    """The number that a constant stands for when compared loosely, or NaN."""
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, datetime):
        return millis(instant(value, "UTC"))  # type: ignore[arg-type]
    if isinstance(value, str) and NUMERIC.fullmatch(value):
        text = value.strip()
        if not text:
            return 0.0
        return float(int(text, 0)) if text[:2].lower() in ("0x", "0o", "0b") else float(text)
    return math.nan


def instant(value: Any, tz: str) -> datetime | None:
    """A naive UTC time, to the millisecond, of a time, a day, an ISO-8601 text in ``tz`` or milliseconds since 1970."""
    if isinstance(value, datetime):
        out = value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    elif isinstance(value, date):
        out = to_utc(datetime(value.year, value.month, value.day), tz)
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not math.isfinite(value) or abs(value) > 8.64e15:
            return None
        try:
            out = EPOCH + timedelta(milliseconds=math.trunc(value))
        except OverflowError:
            return None
    elif isinstance(value, str) and (m := INSTANT.fullmatch(value)):
        try:
            out = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), int((m[7] or "0").ljust(6, "0")[:6]))
        except ValueError:
            return None
        if m[8] and m[8] != "Z":
            sign = -1 if m[8][0] == "-" else 1
            digits = m[8][1:].replace(":", "")
            out -= sign * timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        elif not m[8]:
            out = to_utc(out, tz)
    else:
        return None
    return out.replace(microsecond=out.microsecond // 1000 * 1000)


def millis(at: datetime) -> float:
    return (at - EPOCH) / timedelta(milliseconds=1)


def flattened(value: Any, seen: tuple[int, ...] = ()) -> Any:
    """The constant that a list or mapping binds as: its first scalar, or False if it has none."""
    if isinstance(value, dict):
        value = list(value.values())
    if not isinstance(value, (list, tuple, set, frozenset)):
        return value
    if id(value) in seen:
        raise TypeError("a value that contains itself can't be compared")
    for item in value:
        out = flattened(item, (*seen, id(value)))
        if not (isinstance(item, (list, tuple, dict, set, frozenset)) and out is False):
            return out
    return False


def all_flattened(value: Any, seen: tuple[int, ...] = ()) -> list[Any]:
    if isinstance(value, dict):
        value = list(value.values())
    if not isinstance(value, (list, tuple)):
        return [value]
    if id(value) in seen:
        raise TypeError("a value that contains itself can't be compared")
    return [x for item in value for x in all_flattened(item, (*seen, id(value)))]


def like_pattern(pattern: str) -> str:
    """A Spark LIKE pattern: ``%`` and ``_`` are wildcards unless a backslash precedes them; other backslashes are plain.

    Runs of ``%`` become one, so that matching stays linear.
    """
    out, i = [], 0
    while i < len(pattern):
        c, pair = pattern[i], pattern[i : i + 2]
        if pair in ("\\%", "\\_"):
            out.append(pair)
            i += 2
            continue
        if c == "\\":
            out.append("\\\\")
        elif c != "%" or out[-1:] != ["%"]:
            out.append(c)
        i += 1
    return "".join(out)


def column(value: Any) -> Column:
    """A Spark literal. Times go as text, which no zone of the session or the machine can shift."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def truthy(value: Any) -> bool:
    """How a constant reads in a boolean column."""
    return value not in ("false", "0") and bool(value) and not (isinstance(value, float) and math.isnan(value))
