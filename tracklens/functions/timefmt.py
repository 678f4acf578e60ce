"""Times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms(ms: Column) -> Column:
    """HH:MM:SS, rest cut off."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm."""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def parse_hms(text: Column) -> Column:
    """Seconds of H:M:S, M:S or S (fractions too); null if blank."""
    t = F.trim(text)
    total = F.aggregate(F.split(t, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    return F.when(t != "", total)


def parse_srt_time(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm or HH:MM:SS.mmm."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+)[,.](\d+)", i).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
