"""Times of day as text and numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ column, free of time zones."""
    since = f"(`{ts}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    part = lambda unit: F.expr(f"extract({unit} FROM {since})").cast("long")
    seconds = F.expr(f"floor(extract(SECOND FROM {since}) * 1000)").cast("long")
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000 + seconds


def seconds_of_day(text: Column) -> Column:
    """``hh:mm:ss.sss`` as seconds; null where a part is no number."""
    parts = F.split(F.trim(text), ":")
    part = lambda i: F.get(parts, F.lit(i - 1)).try_cast("double")
    return F.when(F.size(parts) == 3, part(1) * 3600 + part(2) * 60 + part(3))


def packed_seconds(value: Column) -> Column:
    """``HHMMSS.s`` as seconds of the day."""
    n = value.try_cast("double")
    return F.floor(n / 10000) * 3600 + F.floor(F.pmod(n, F.lit(10000.0)) / 100) * 60 + F.pmod(n, F.lit(100.0))


def compat_code(text: Column, hours: int = 2) -> Column:
    """Hour moved by ``hours``, minute and the unpadded seconds run together
    without the point, as a number: the encoding of older base-station files."""
    parts = F.split(F.trim(text), ":")
    hour = F.pmod(F.get(parts, F.lit(0)).try_cast("int") + hours, F.lit(24))
    second = F.regexp_replace(F.get(parts, F.lit(2)).try_cast("double").cast("string"), "\\.", "")
    return F.concat(F.format_string("%02d", hour), F.get(parts, F.lit(1)), second).try_cast("double")


def clock_text(seconds: Column) -> Column:
    """``hh:mm:ss.sss`` with hours modulo 24."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.pmod((ms / 3_600_000).cast("long"), F.lit(24)), F.pmod((ms / 60_000).cast("long"), F.lit(60)), F.pmod((ms / 1000).cast("long"), F.lit(60)), F.pmod(ms, F.lit(1000)))


def run_label(run_id: Column) -> Column:
    """``YYYYMMDD_HHMMSS`` as ``DD/MM/YYYY HH:MM:SS``; others unchanged."""
    return F.regexp_replace(run_id, r"^(\d{4})(\d\d)(\d\d)_(\d\d)(\d\d)(\d\d)$", "$3/$2/$1 $4:$5:$6")
