"""Epoch arithmetic: buckets, days, hours and export formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(c: Column | str, seconds: int = 60) -> Column:
    return (F.floor(_c(c) / seconds) * seconds).cast("long")


def utc_day(c: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_c(c)), "yyyy-MM-dd")


def utc_hour(c: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_c(c)), "yyyy-MM-dd'T'HH:00'Z'")


def iso(c: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_c(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_of_ms(c: Column | str) -> Column:
    return F.floor(_c(c) / 1000).cast("long")
