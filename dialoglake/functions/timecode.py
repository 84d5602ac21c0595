"""Seconds and time strings. Two roundings exist on purpose: ``format_time`` rounds half to even, ``seconds_to_time_str`` cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock(ms: Column, mark: str) -> Column:
    ms = ms.cast("long")
    hours, minutes, seconds = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", hours, minutes, seconds, ms % 1000)


def format_time(seconds: Column) -> Column:
    """``HH:MM:SS:mmm``; below zero counts as zero; milliseconds are rounded half to even."""
    return _clock(F.rint(F.greatest(seconds, F.lit(0.0)) * 1000), ":")


def seconds_to_time_str(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; below zero, NaN and infinity give zero; milliseconds are cut off the float."""
    sound = F.when(F.isnan(seconds) | (F.abs(seconds) == float("inf")) | (seconds < 0), 0.0).otherwise(seconds)
    whole = F.floor(sound)
    parts = (F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, F.floor((sound * 1000) % 1000))
    return F.format_string("%02d:%02d:%02d,%03d", *parts)


def time_str_to_seconds(text: Column) -> Column:
    """``H:M:S[.,]f`` -> seconds; a fourth part is ignored; what can't be read is 0."""
    parts = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")

    def number(i: int, kind: str) -> Column:
        return F.trim(F.try_element_at(parts, F.lit(i))).try_cast(kind)

    return F.coalesce(number(1, "int") * 3600.0 + number(2, "int") * 60.0 + number(3, "double"), F.lit(0.0))


def colon_ms_to_comma_ms(text: Column) -> Column:
    """``H:MM:SS:m`` or ``H:MM:SS.m`` -> ``HH:MM:SS,mmm``, the last number read as whole milliseconds."""
    form = r"^([0-9]+):([0-9]{1,2}):([0-9]{1,2})[:.]([0-9]{1,3})$"

    def part(i: int, width: int) -> Column:
        digits = F.regexp_extract(text, form, i)
        return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))

    whole = F.concat(part(1, 2), F.lit(":"), part(2, 2), F.lit(":"), part(3, 2), F.lit(","), part(4, 3))
    colons = F.length(text) - F.length(F.replace(text, F.lit(":")))
    return F.when(F.contains(text, F.lit(",")), text).when(text.rlike(form), whole).when(colons >= 3, F.regexp_replace(text, "^(?s)(.*):", "$1,")).otherwise(text)


def format_distance(distance: Column) -> Column:
    """Six decimals; null becomes empty."""
    return F.when(distance.isNull(), "").otherwise(F.format_string("%.6f", distance))


def is_integer_ms(seconds: Column, tolerance: float = 1e-6) -> Column:
    ms = seconds * 1000
    return F.abs(ms - F.rint(ms)) <= tolerance
