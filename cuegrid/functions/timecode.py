"""Timestamps of SRT, WebVTT and ASS, to and from milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(x: Column) -> Column:
    return F.expr("cast(null as bigint)") if x is None else x.try_cast("long")


def _hms(h: Column, m: Column, s: Column) -> Column:
    return (h * 3600 + m * 60 + s) * 1000


def srt_ms(ts: Column) -> Column:
    """Null where the text is no timestamp.  Fractions of one or two digits are tenths or hundredths."""
    pattern = r"^(\d+):(\d+):(\d+)[,:](\d+)"
    t = F.regexp_replace(ts, r"\.", ",")
    part = lambda i: _n(F.regexp_extract(t, pattern, i))
    digits = F.length(F.regexp_extract(t, pattern, 4))
    scale = F.when(digits == 1, 100).when(digits == 2, 10).otherwise(1)
    return F.when(t.rlike(pattern), _hms(part(1), part(2), part(3)) + part(4) * scale)


def vtt_ms(ts: Column) -> Column:
    pattern = r"^(?:(\d+):)?(\d+):(\d+)(?:[.,](\d+))?$"
    part = lambda i: F.coalesce(_n(F.regexp_extract(ts, pattern, i)), F.lit(0))
    frac = F.rpad(F.substring(F.regexp_extract(ts, pattern, 4), 1, 3), 3, "0")
    return F.when(ts.rlike(pattern), _hms(part(1), part(2), part(3)) + _n(frac))


def ass_ms(ts: Column) -> Column:
    pattern = r"^\s*(\d+):(\d+):(\d+)\.(\d+)"
    part = lambda i: _n(F.regexp_extract(ts, pattern, i))
    return F.when(ts.rlike(pattern), _hms(part(1), part(2), part(3)) + part(4) * 10)


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    div = lambda x, n: F.floor(x / n)
    return div(ms, 3600000), div(ms % 3600000, 60000), div(ms % 60000, 1000), ms % 1000


def srt_stamp(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(ms))


def vtt_stamp(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", *_parts(ms))


def ass_stamp(ms: Column) -> Column:
    h, m, s, r = _parts(ms)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, F.floor(r / 10))
