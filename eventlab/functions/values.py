"""Scalar functions over event columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 8601 durations in days, hours, minutes and seconds.
_DURATION = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def duration_seconds(text: str) -> float:
    m = _DURATION.fullmatch(text)
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text}")
    d, h, mi, s = (float(x or 0) for x in m.groups())
    return d * 86400 + h * 3600 + mi * 60 + s


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_ms(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def rfc3339(ts: Column) -> Column:
    """UTC text with six digits of the second; the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def partition_key(*parts: Column) -> tuple[Column, Column]:
    """The parts joined with ``:``, and whether the key is valid: no part empty or with a colon, at most 256 characters."""
    key = F.concat_ws(":", *parts)
    ok = F.length(key) <= 256
    for p in parts:
        ok = ok & F.coalesce((F.length(p) > 0) & ~p.contains(":"), F.lit(False))
    return key, ok


def predicate(value: Column, op: str, arg) -> Column:
    """A declared comparison; texts of numbers compare as numbers, what is no number is never above or below."""
    if op in ("eq", "ne", "in", "not_in"):
        found = value.cast("string").isin([str(a) for a in (arg if op.endswith("in") else [arg])])
        return F.coalesce(~found if op.startswith("n") else found, F.lit(op.startswith("n")))
    number, bound = value.cast("string").try_cast("decimal(38,9)"), F.lit(arg).cast("decimal(38,9)")
    test = {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[op]
    return F.coalesce(test, F.lit(False))


def within(ts: Column, now: Column, duration: str) -> Column:
    """Whether ``ts`` is at most ``duration`` before ``now``; false when it is no timestamp."""
    t = F.try_to_timestamp(ts) if not isinstance(ts, str) else F.try_to_timestamp(F.col(ts))
    return F.coalesce(micros(now) - micros(t) <= int(duration_seconds(duration) * 1e6), F.lit(False))


def local_hour(ts: Column, zone: str) -> tuple[Column, Column]:
    """Hour and weekday (0 is Monday) in a named zone."""
    there = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return F.hour(there), F.weekday(there)


def intensity(ts: Column, diurnal: Sequence[float], weekly: Sequence[float]) -> Column:
    """diurnal[hour] x weekly[weekday], each curve scaled to mean 1."""
    d = [x * 24 / sum(diurnal) for x in diurnal]
    w = [x * 7 / sum(weekly) for x in weekly]
    return F.element_at(F.lit(d), F.hour(ts) + 1) * F.element_at(F.lit(w), F.weekday(ts) + 1)


def infer_type(text: Column) -> Column:
    """The kind of a JSON scalar's text: boolean, integer, number, datetime, decimal or string; null for null."""
    inner = F.substring(text, 2, F.length(text) - 2)
    return (
        F.when(text.isNull() | (text == "null"), F.lit(None).cast("string"))
        .when(text.isin("true", "false"), "boolean")
        .when(text.rlike(r"^-?\d+$"), "integer")
        .when(text.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), "number")
        .when(inner.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), "datetime")
        .when(inner.rlike(r"^-?\d+\.\d+$"), "decimal")
        .otherwise("string")
    )


#: Kinds of corruption and the value types they are for (fixed values).
CORRUPTIONS = {
    "alpha_string": ("decimal", "integer", "number"),
    "locale_comma": ("decimal",),
    "empty_string": ("string", "decimal"),
    "truncate": ("string",),
    "mojibake": ("string",),
    "wrong_type_number": ("string",),
    "string_wrap": ("integer", "number", "boolean"),
    "negative_flip": ("integer", "number"),
    "int_overflow": ("integer",),
    "epoch_millis": ("datetime",),
    "invalid_timestamp": ("datetime",),
    "naive_local": ("datetime",),
    "bool_string": ("boolean",),
    "out_of_vocabulary": ("enum",),  # of values whose field has an enum, which their text doesn't show
}


def corrupt(text: Column, kind: Column) -> Column:
    """JSON text of a scalar after the corruption named by ``kind``."""
    inner = F.substring(text, 2, F.length(text) - 2)

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    results = {
        "alpha_string": F.lit('"abc"'),
        "locale_comma": F.replace(text, F.lit("."), F.lit(",")),
        "empty_string": F.lit('""'),
        "truncate": quoted(F.substring(inner, 1, 1)),
        "mojibake": F.lit('"Ã©Ã¶Ã±"'),
        "wrong_type_number": F.lit("123"),
        "string_wrap": F.concat(F.lit('"\\"'), text, F.lit('\\""')),
        "negative_flip": F.when(F.startswith(text, F.lit("-")), F.substring(text, 2, F.length(text))).otherwise(F.concat(F.lit("-"), text)),
        "int_overflow": F.lit("9007199254740993"),
        "epoch_millis": F.lit("1781187785123"),
        "invalid_timestamp": F.lit('"2026-13-45T99:99:99Z"'),
        "naive_local": quoted(F.rtrim(inner, F.lit("Z"))),
        "bool_string": F.lit('"yes"'),
        "out_of_vocabulary": F.lit('"__unknown__"'),
    }
    out = None
    for name, expr in results.items():
        out = F.when(kind == name, expr) if out is None else out.when(kind == name, expr)
    return out.otherwise(text)
